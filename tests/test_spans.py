import itertools

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import datasets, decode, evaluate, post, present, redact, rules, windows
from spanloom.plans.engine import Engine, cli_options, device, register_sql

LABELS = ["O", "B-X", "I-X", "E-X", "S-X", "B-Y", "I-Y", "E-Y", "S-Y"]
T = L.label_table(LABELS)
SPANS = "array<struct<start:int,end:int,score:float,label:string>>"


def emit(n, **over):
    e = np.full((n, 9), -8.0, np.float32)
    e[:, 0] = -0.5
    for k, v in over.items():
        t, c = k[1:].split("_", 1)
        e[int(t), LABELS.index(c.replace("_", "-"))] = v
    return e


def test_viterbi_cases():
    p = decode.viterbi(T, emit(3, t1_I_X=2))
    assert p[1] != 2 and p[0] == p[2] == 0
    assert decode.viterbi(T, emit(2, t1_B_X=3))[1] in (0, 3, 4, 7, 8)
    e = emit(6, t1_B_X=1, t2_I_X=1, t3_E_X=1, t5_S_Y=2)
    p = decode.viterbi(T, e)
    assert p[1:4].tolist() == [1, 2, 3] and p[5] == 8
    (a, b) = decode.assemble(T, p, e)
    assert a[:3] == (0, 1, 3) and a[3] == pytest.approx(np.e, abs=1e-5) and b[:3] == (1, 5, 5)
    assert decode.viterbi(T, emit(1, t0_S_X=1, t0_B_X=2)).tolist() == [4]


def legal(path):
    open_cat = None
    for k in path:
        t, c = T.tag[k], T.category[k]
        if t in (L.I, L.E) and open_cat != c or t in (L.O, L.B, L.S) and open_cat is not None:
            return False
        open_cat = c if t in (L.B, L.I) else None
    return open_cat is None


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        for _ in range(12):
            e = (rng.integers(-40, 8, (n, 9)) / 8).astype(np.float32)
            best = max(sum(float(e[t, k]) for t, k in enumerate(p)) for p in itertools.product(range(9), repeat=n) if legal(p))
            p = decode.viterbi(T, e)
            assert legal(p) and sum(float(e[t, k]) for t, k in enumerate(p)) == best


def test_viterbi_without_a_closed_path():
    t = L.label_table(["B-X", "I-X"])
    assert decode.viterbi(t, np.array([[1, 2], [3, 1]], np.float32)).tolist() == [1, 0]


def test_assemble_of_illegal_path():
    e = np.zeros((4, 9), np.float32)
    assert decode.assemble(T, np.array([1, 6, 3, 0]), e) == [(0, 0, 2, pytest.approx(2 / 3))]
    assert decode.assemble(T, np.array([1, 7, 3, 0]), e) == []


def test_strict_and_islands_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(d, t, [float(x) for x in rng.integers(-40, 8, 9) / 8]) for d in range(6) for t in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, tok_pos int, logp array<float>")
    a = {(r.doc_id, s.cat, s.tok_begin, s.tok_end, round(s.score, 4)) for r in decode.decode_strict(df, T).collect() for s in r.spans}
    paths = decode.paths_strict(df, T).join(F.broadcast(T.frame(spark)), "class_id")
    b = {(r.doc_id, T.categories.index(r.category), r.tok_begin, r.tok_end, round(r.score, 4)) for r in decode.spans_of_paths(paths).collect()}
    assert a == b and a
    assert decode.decode_strict(df, T, threshold=99).filter("size(spans) > 0").count() == 0


def test_lenient():
    f = lambda s: decode.lenient_spans(s.split(), list(range(len(s.split()))), [k + 1 for k in range(len(s.split()))])
    assert f("O B-X I-X E-X O") == [(1, 4, "X")]
    assert f("B-X B-X O") == [(0, 1, "X"), (1, 2, "X")]
    assert f("I-X I-X O") == [(0, 2, "X")] and f("E-X E-X") == [(0, 2, "X")]
    assert f("B-X I-Y") == [(0, 1, "X"), (1, 2, "Y")] and f("S-X I-X") == [(0, 1, "X"), (1, 2, "X")] and f("B-X") == [(0, 1, "X")]
    assert decode.lenient_spans(["B-X", "B-Y", "E-X"], [0, 1, 1], [1, 1, 2]) == [(0, 2, "X")]


def test_windows(spark):
    for halo, n_windows in ((1, None), (7, None), (1024, None)):
        for w in (2 * halo + 1, 2 * halo + 13, 4096):
            ns = [0, 1, w - 1, w, w + 1, 2 * w, 3 * w + 17]
            df = spark.createDataFrame([(n,) for n in ns], "n int").select("n", windows.windows("n", w, halo).alias("w"))
            for r in df.collect():
                own = [(x.start + x.lo, x.start + x.hi) for x in r.w]
                assert own[0][0] == 0 and own[-1][1] == r.n and all(a[1] == b[0] for a, b in zip(own, own[1:])), (halo, w, r.n)
                assert all(x.wlen <= w and x.start + x.wlen <= r.n for x in r.w)


def test_too_narrow_window_fails(spark):
    df = spark.createDataFrame([(5,)], "n int")
    assert df.select(windows.windows("n", 8, 4).alias("w")).first().w[0].wlen == 5
    with pytest.raises(Exception, match="tokens need a window"):
        df.select(windows.windows("n", 4, 4)).collect()


def cleaned(spark, text, spans, f):
    df = spark.createDataFrame([(text, spans)], f"text string, spans {SPANS}")
    return [(s.start, s.end) for s in df.select(f("text", "spans").alias("s")).first().s]


def whole(text, label="private_person"):
    return [(0, len(text.encode()), 0.5, label)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("三宅、小田切", ["三宅", "小田切"]), ("山田太郎（ヤマダタロウ）", ["山田太郎", "ヤマダタロウ"]), ("山田　太郎", ["山田　太郎"]), ("、／|", []), (" A, B ", ["A", "B"]), ("==x=", ["x="]), ("　x　", ["x"])],
)
def test_persons(spark, text, want):
    got = cleaned(spark, text, whole(text), post.clean)
    assert [text.encode()[s:e].decode() for s, e in got] == want


def test_trim_keeps_other_labels_whole(spark):
    assert cleaned(spark, "= a,b= ", whole("= a,b= ", "secret"), post.clean) == [(2, 6)]
    assert cleaned(spark, "ab", [(-1, 1, 1.0, "x"), (1, 1, 1.0, "x"), (0, 3, 1.0, "x"), (0, 2, 1.0, "x")], post.clean) == [(0, 2)]
    assert cleaned(spark, " =\t ", whole(" =\t ", "secret"), post.clean) == []


def test_merge(spark):
    text = "Ada  Lovelace, Bob     Carl"
    spans = [(5, 13, 1.0, "LASTNAME"), (0, 3, 1.0, "FIRSTNAME"), (15, 18, 1.0, "FIRSTNAME"), (23, 27, 1.0, "FIRSTNAME"), (0, 2, 1.0, "USERNAME")]
    assert cleaned(spark, text, spans, post.clean_lenient) == [(0, 13), (15, 18), (23, 27)]


def brute_redact(raw, spans, stand):
    out, cursor = b"", 0
    for s, e, label in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s < 0 or e <= s or e > len(raw) or e <= cursor:
            continue
        if s > cursor:
            out += raw[cursor:s]
        out += stand(label).encode()
        cursor = e
    return (out + raw[cursor:]).decode()


def test_redaction(spark):
    rng = np.random.default_rng(2)
    rows = [("abcdef", None), ("", []), (None, [(0, 1, 1.0, "x")]), ("abcdef", [(0, 4, 1.0, "EMAIL"), (2, 6, 1.0, "PIN"), (1, 3, 1.0, "URL")]), ("abcdef", [(0, 2, 1.0, "a"), (2, 4, 1.0, "b"), (9, 12, 1.0, "c")])]
    for _ in range(40):
        rows.append(("x" * 12 + "é" * 4, [(int(a), int(a + b), 1.0, "SSN") for a, b in rng.integers(0, 6, (5, 2)) * 2]))
    df = spark.createDataFrame(rows, f"text string, spans {SPANS}")
    for r in df.select("text", "spans", redact.redact("text", "spans").alias("a"), redact.redact("text", "spans", None).alias("b")).collect():
        if r.text is None:
            assert r.a is None
            continue
        spans = [(s.start, s.end, s.label) for s in r.spans or []]
        assert r.a == brute_redact(r.text.encode(), spans, lambda _: "***")
        assert r.b == brute_redact(r.text.encode(), spans, lambda x: L.REDACTION_TAGS.get(x, "[REDACTED]"))


def test_mask(spark):
    df = spark.createDataFrame([("ab é cd", [(3, 6, 1.0, "x")])], f"text string, spans {SPANS}")
    assert df.select(redact.mask("text", "spans")).first()[0] == "ab ███d"


def test_evaluation(spark):
    kind = "row_no int, text string, spans array<struct<start:int,end:int,label:string>>"
    gold = spark.createDataFrame([(0, "t", [(0, 4, "A"), (0, 4, "A"), (5, 9, "A")]), (1, "u", [(0, 3, "B")]), (2, "v", [(0, 5, "A")]), (3, "w", [])], kind)
    pred = spark.createDataFrame([(0, "t", [(0, 4, "A"), (6, 9, "A")]), (1, "u", [(1, 3, "C")]), (2, "v", [(0, 3, "B")]), (3, "w", [])], kind)
    got = {r.label: (r.tp, r.fp, r.fn, r.partial) for r in evaluate.score(gold, pred).collect()}
    assert got == {"A": (1, 1, 2, 1), "B": (0, 1, 1, 0), "C": (0, 1, 0, 0)}
    by = {r.label: r for r in evaluate.report(gold, pred).collect()}
    assert by["micro"].precision == 0.25 and by["macro"].f1 == pytest.approx((2 / 5) / 3)
    # a missed span isn't partial by overlapping a right one
    g = spark.createDataFrame([(0, "t", [(0, 4, "A"), (2, 6, "A")])], kind)
    p = spark.createDataFrame([(0, "t", [(0, 4, "A")])], kind)
    assert evaluate.score(g, p).first().partial == 0
    with pytest.raises(Exception, match="texts differ"):
        evaluate.score(gold, pred.withColumn("text", F.lit("z"))).collect()
    with pytest.raises(Exception, match="only one side"):
        evaluate.score(gold, pred.filter("row_no < 2")).collect()
    assert evaluate.report(gold.limit(0), pred.limit(0)).count() == 2


def test_bioes_labels(spark):
    labels = ["O", *(f"{t}-{c}" for c in ("private_person", "EMAIL") for t in "BIES")]
    df = spark.createDataFrame(
        [([(0, 3), (3, 3), (4, 8), (9, 12), (13, 14)], [(0, 12, "private_person"), (13, 14, "private_email"), (4, 8, "private_email"), (0, 1, "unknown")]), (None, None), ([(0, 1)], None)],
        "t array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:string>>",
    )
    got = [r[0] for r in df.select(datasets.bioes_labels("t", "s", labels)).collect()]
    assert got == [[1, -100, 8, 3, 8], None, [0]]


def test_dataset_checks(spark):
    df = spark.createDataFrame([("abcdef", [(0, 3, "x"), (2, 4, "x")]), ("ab", [(0, 3, "x")]), ("ab", [(0, 1, "q")]), ("ab", [])], "text string, spans array<struct<start:int,end:int,label:string>>")
    got = [(r.bad_offsets, r.bad_label, r.overlapping) for r in datasets.faults(df, ["x"]).collect()]
    assert got == [(False, False, True), (True, False, False), (False, True, False), (False, False, False)]
    part = datasets.with_split(spark.range(2000), 0.2, id_col="id").filter("is_validation").count()
    assert 330 < part < 470


def test_present(spark):
    assert present.wrap_ranges("aa bb cc\n\nlongword", 5) == [(0, 5), (6, 8), (9, 9), (10, 15), (15, 18)]
    df = spark.createDataFrame([("aa bb cc", [(3, 8, 1.0, "x")]), (None, None)], f"text string, s {SPANS}")
    got = df.select(present.on_lines(present.wrapped("text", 5), "s").alias("l")).collect()
    assert [len(x.spans) for x in got[0].l] == [1, 1] and got[1].l is None


def test_rules_and_engine(spark):
    text = "Write to a.b@mail1.example.com or +1 (826) 555-4081, é 190.137.223.204 on 2024-01-02"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "x", "k")], "doc_id int, text string, entities string")
    got = Engine().redact(df.drop("entities"), labels=True).orderBy("doc_id").collect()
    assert got[0].redacted == "Write to [EMAIL] or [PHONE], é [ACCOUNT] on [DATE]"
    assert [r.redacted for r in got[1:]] == [None, "", "x"] and got[1].entities is None and got[2].entities == []
    for s in got[0].entities:
        assert text.encode()[s.start : s.end].decode()
    assert Engine().classify(df.limit(0)).count() == 0
    assert rules.RULES[0][0] == "private_email" and Engine().info(spark).count() > 2


def test_sql_functions(spark):
    register_sql(spark)
    r = spark.sql("SELECT sl_pieces('a 1234') AS p, sl_redaction_tag('PIN') AS t, sl_redaction_tag('q') AS q, sl_redact('to a@b.example') AS x").first()
    assert (list(r.p), r.t, r.q, r.x) == (["a", " ", "123", "4"], "[ACCOUNT]", "[REDACTED]", "to [EMAIL]")


def test_sql_redaction_is_the_engines(spark):
    """sl_redact replaces what Engine.redact does, on all documents."""
    register_sql(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = Engine().redact(docs, labels=True).selectExpr("doc_id", "redacted", "sl_redact(text) AS other")
    assert own.count() > 100 and own.filter("redacted <> other").count() == 0 and own.filter("redacted LIKE '%[EMAIL]%'").count() > 0


def test_table_function(spark):
    register_sql(spark)
    got = spark.sql("SELECT * FROM sl_pretokens('a 1234')").collect()
    assert [tuple(r) for r in got] == [(0, 1, "a"), (1, 2, " "), (2, 5, "123"), (5, 6, "4")]
    texts = spark.createDataFrame([(1, "xy é"), (2, None), (3, "")], "i int, t string")
    texts.createOrReplaceTempView("sl_texts")
    assert [tuple(r) for r in spark.sql("SELECT i, piece FROM sl_texts, LATERAL sl_pretokens(t) ORDER BY i, start").collect()] == [(1, "xy"), (1, " é")]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 1.0])
def test_exact_split(spark, share):
    import hashlib

    ids = [f"d{k}" for k in range(997)]
    got = datasets.with_exact_split(spark.createDataFrame([(i,) for i in ids], "id string"), share, 5, "id")
    want = sorted(ids, key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))[: int(997 * share)]
    assert {r.id for r in got.filter("is_validation").collect()} == set(want) and got.count() == 997
    assert datasets.with_exact_split(spark.createDataFrame([], "id string"), 0.5, 5, "id").collect() == []


def test_options():
    assert cli_options(["0.7", "cuda:1", "--labels", "--replacement", "#"]) == {"threshold": 0.7, "device": "cuda:1", "labels": True, "replacement": "#"}
    assert device("vulkan:2") == ("vulkan", 2)
    for bad in (["--nope"], ["-t"]):
        with pytest.raises(ValueError):
            cli_options(bad)
    with pytest.raises(ValueError):
        device("tpu")


def test_classes_of_tokens_in_order_are_those_of_a_search():
    import random

    ids = {x: i for i, x in enumerate(["O", *(f"{t}-{c}" for c in "XY" for t in "BIES"), "S-Z"])}
    r = random.Random(5)
    for _ in range(200):
        ends = np.sort(np.array([r.randrange(30) for _ in range(r.randrange(12))], np.int64))
        starts = np.maximum(ends - r.randrange(3), 0)
        spans = [(s := r.randrange(30), s + r.randrange(6), r.choice("XYZ")) for _ in range(r.randrange(6))]
        got = datasets.classes_of(starts, ends, spans, ids)
        want = np.where(starts == ends, datasets.IGNORED, 0)
        for s, e, c in spans:
            hit = np.flatnonzero((starts != ends) & (starts < e) & (s < ends))
            for k, at in enumerate(hit):
                tag = "S" if len(hit) == 1 else "B" if k == 0 else "E" if k == len(hit) - 1 else "I"
                want[at] = ids.get(f"{tag}-{c}", want[at])
        assert got.tolist() == want.tolist()
        assert datasets.classes_of(starts[::-1], ends[::-1], spans, ids).shape == got.shape


def test_classes_of_a_long_text_take_no_square():
    import time

    at = np.arange(400_000)
    began = time.process_time()
    got = datasets.classes_of(at * 2, at * 2 + 1, [(k * 2, k * 2 + 1, "X") for k in range(0, 400_000, 4)], {"O": 0, "S-X": 1})
    assert got.sum() == 100_000 and time.process_time() - began < 10


def test_class_rows_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "Ann lee 日本 42"), (None, "Ann lee 日本 42"), (2, None), (3, ""), (4, "日本")], "doc_id long, text string")
    got = datasets.class_rows(rows, ("doc_id",), r"[A-Za-z0-9]+", [("X", r"[A-Z][a-z]+(?: [a-z]+)?"), ("Y", r"[0-9]+")], ["O", "B-X", "I-X", "E-X", "S-X", "S-Y"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, i, c)) for k in (1, None) for i, c in enumerate((1, 3, 5)))


def test_merged_spans_are_those_of_a_search(spark):
    import random

    r = random.Random(6)
    text = "ab \t\u3000c\u2028 \n  de é    f"
    rows = []
    for _ in range(80):
        rows.append((text, [(s := r.randrange(len(text)), s + r.randrange(4), 1.0 * k, r.choice(["x", "y", None])) for k in range(r.randrange(7))]))
    df = spark.createDataFrame([*rows, (None, None), (None, [(0, 1, 1.0, "x"), (2, 3, 2.0, "x"), (1, 2, 3.0, "x")])], f"text string, s {SPANS}")
    got = [None if x.m is None else [tuple(y) for y in x.m] for x in df.select(post.merge_near("text", "s").alias("m")).collect()]
    want = []
    for t, own in rows:
        out = []
        for s, e, score, label in sorted(own, key=lambda x: x[0]):
            if out and label is not None and out[-1][3] == label and s - out[-1][1] <= 4 and (s <= out[-1][1] or not t[out[-1][1] : s].strip()):
                out[-1] = (out[-1][0], max(e, out[-1][1]), score, label)
            else:
                out.append((s, e, score, label))
        want.append(out)
    assert got[: len(rows)] == want and got[len(rows) :] == [None, [(0, 3, 2.0, "x")]]  # spans that touch need no text between


def test_merging_takes_no_square(spark):
    import time

    text = "abcde fghij, " * 40_000
    began = time.process_time()
    assert len(post.merged(text, [(13 * k + d, 13 * k + d + 5, "x") for k in range(40_000) for d in (0, 6)])) == 40_000 and time.process_time() - began < 10
    rows = spark.createDataFrame([(1, text), (2, None), (None, "abcde  fghij x"), (None, "abcde  fghij x")], "doc_id long, text string")
    began = time.time()
    assert post.merged_rows(rows, ("doc_id",), "[A-Za-z]{5,}", "x").count() == 40_002 and time.time() - began < 30


def test_line_rows_are_those_of_columns(spark):
    import random

    r = random.Random(8)
    rows = []
    for k in range(60):
        text = "".join(r.choice("ab é日 \n") for _ in range(r.randrange(40)))
        rows.append((k % 7 or None, text, [(s := r.randrange(len(text) + 1), s + 1 + r.randrange(5), 1.0, "x") for _ in range(r.randrange(5))]))
    df = spark.createDataFrame([*rows, (9, None, None), (9, "", []), (9, "a b", None)], f"n int, text string, s {SPANS}").repartition(2)
    got = present.line_rows(df, ("n",), "s", 6)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    lines = df.select("n", F.posexplode(present.on_lines(present.wrapped("text", 6), F.coalesce("s", F.array().cast(SPANS)))).alias("line", "l"))
    want = lines.selectExpr("n", "line", "l.start", "l.end", "size(l.spans)")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_parts_of_texts_are_bounded():
    from spanloom.functions.arrays import parts_of

    sizes = np.array([0, 5, 5, 11, 30, 0, 1, 0])
    got = list(parts_of(sizes, 10))
    assert [k for a, b in got for k in range(a, b)] == list(range(8)) and all(b - a == 1 or sizes[a:b].sum() <= 10 for a, b in got)
    assert list(parts_of(sizes[:0], 10)) == []
