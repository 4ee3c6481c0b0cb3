"""Token counts, language, private data, toxicity, chat formatting."""

import base64
import copy
import dataclasses
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, assert_same
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B
from spanloom.llm import chatformat, langid, pii, queries, store, tokencount, toxicity

MIDDLE = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n  x", "don't they'll WE'VE ''s", "naïve größe 日本語 текст", "a 　 b c", "x" * 40_000, "12 3456 " * 9000, "!?! -- (a)", "é \U0001f600\U0001f600", "tab\t\ttab \r\n\r\n end   "]


def odd_docs(spark, extra=""):
    """Odd texts, twice, under a null id too, between columns whose names clash with the operators' own."""
    rows = [(None if i == 3 else i % len(ODD), t, "en" if i % 3 else None, "s", 5, "clash", 1) for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _sl_text string, id int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def own_encoder():
    with open(tokencount.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [16, tokencount.TABLE_SIZE])
def test_token_counts(spark, documents, size):
    enc = own_encoder()
    for docs in (documents, odd_docs(spark)):
        want = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.text is None else len(enc.encode_ordinary(r.text))) for r in docs.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.n_tokens is None else r.n_tokens) for r in tokencount.count_tokens(docs, table_size=size).collect())
        assert got == want
    assert tokencount.count_tokens(documents.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op1_token_counts", "op10_mixing_by_tokens"])
def test_counts_are_those_of_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sdtmrevl 12.\n\t 　éß日 \r-")), max_size=30), max_size=4))
def test_pretokens_are_the_patterns(texts):
    import regex

    raw, offsets, _ = B.text_buffers(pa.array(texts, pa.string()))
    s, e, d = tokencount.pretokens(raw, offsets)
    got = sorted((int(k), bytes(raw[a:b]).decode()) for a, b, k in zip(s, e, d))
    assert got == sorted((k, p) for k, t in enumerate(texts) for p in regex.findall(tokencount.PATTERN, t))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("lang IS NOT NULL")
    model = langid.fit_on(docs.filter("doc_id % 2 = 0"), sample=60, landmarks=20)
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").filter("predicted_lang IS NOT NULL")
    assert got.filter("predicted_lang = lang").count() > 0.97 * got.count()


def test_language_scores_are_the_kernel_machine():
    texts, langs = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "das haus und der baum"], ["de", "en", "fr", "de"]
    m = langid.fit(texts, langs, landmarks=2, ridge=0.1)
    grams = lambda t: {int(h) for h in np.flatnonzero(langid.presence(*B.text_buffers(pa.array([t]))[:2])[0])}
    k = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    gram = np.array([[k(a, b) for b in texts] for a in texts])
    y = np.where(np.array(langs)[:, None] == np.array(m.langs), 1.0, -1.0)
    # with every text a landmark, ridge in the map is kernel ridge
    coef = np.linalg.solve(gram + 0.1 * np.eye(4), y)
    test = "die katze und the house"
    want = np.array([k(test, t) for t in texts]) @ coef
    assert np.allclose(m.scores(*B.text_buffers(pa.array([test]))[:2])[0], want, atol=1e-3)


def test_language_ties_and_long_texts(monkeypatch):
    same = langid.fit(["abcd", "abcd"], ["xx", "aa"], landmarks=1)
    s = same.scores(*B.text_buffers(pa.array(["abcd"]))[:2])[0]
    assert same.langs == ["aa", "xx"] and s[0] == pytest.approx(s[1], abs=1e-6) and s.round(5).argmax() == 0
    texts = ["", "x", "häuser und bäume " * 9, "the quick brown fox"]
    whole = langid.presence(*B.text_buffers(pa.array(texts))[:2])
    monkeypatch.setattr(langid, "STEP", 7)
    assert np.array_equal(whole, langid.presence(*B.text_buffers(pa.array(texts))[:2]))


def test_language_of_odd_rows(spark, documents):
    docs = odd_docs(spark)
    got = langid.identify(docs, langid.fit_on(documents, sample=20, landmarks=5)).collect()
    assert len(got) == len(ODD) * 2 and sum(r.predicted_lang is None for r in got) == 4
    assert all(r.predicted_lang is None for r in langid.identify(docs, langid.fit([], [])).collect())
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit_on(empty)).collect() == []


@pytest.fixture(scope="module")
def trees():
    return pii.fit()


def test_private_spans_of_unseen_examples(trees):
    made = pii.examples(1500, seed=99)
    found = trees.redactions([t for t, _ in made])
    inside = [any(s <= a and b <= e for s, e, _ in got) for (_, spans), got in zip(made, found) for a, b in spans]
    clean = [not got for (_, spans), got in zip(made, found) if not spans]
    assert np.mean(inside) > 0.97 and np.mean(clean) > 0.93


def test_trees_against_their_definition():
    """One tree of two levels by trying every cut at every node, and the sum of its steps."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), (rng.random(80) < 0.4).astype(float)
    got = pii.Trees(trees=3, depth=2, step=0.3, bins=16, ridge=1.0).fit(x, y)
    score = np.full(80, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def best(rows):
            def gain(c, v):
                low = rows & (x[:, c] <= v)
                high = rows & ~low
                return g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)

            return max(gain(c, v) for c in range(3) for v in [*range(5), np.inf])

        # any cut of the greatest gain will do, so gains are compared and leaves are taken as they were cut
        column, limit, value = got.made[_]
        rows = np.ones(80, bool)
        gain_of = lambda rows, k: sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (rows & (x[:, column[k]] <= limit[k]), rows & (x[:, column[k]] > limit[k])))
        right = x[:, column[0]] > limit[0]
        for k, part in ((0, rows), (1, ~right), (2, right)):
            assert gain_of(part, k) == pytest.approx(best(part), abs=1e-9)
        for part, k, at in ((~right, 1, 0), (right, 2, 2)):
            for side, leaf in ((part & (x[:, column[k]] <= limit[k]), at), (part & (x[:, column[k]] > limit[k]), at + 1)):
                assert value[leaf] == pytest.approx(0.3 * g[side].sum() / (h[side].sum() + 1), abs=1e-12)
                score[side] += value[leaf]
    assert np.allclose(got.score(x), score)


def test_private_thresholds_keep_their_recall():
    """On the held-out quarter each kind's threshold keeps RECALL of its private spans, and no lower one is nearer than the best look-alike allows."""
    count = 1200
    model, held = pii.fit(count), pii.examples(count)[count * 3 // 4 :]
    x, y, kinds = pii._labelled(held)
    score = model.trees.score(x)
    for k in range(len(pii.KINDS)):
        good, bad = score[(kinds == k) & (y > 0)], score[(kinds == k) & (y == 0)]
        if len(good):
            t = model.thresholds[k]
            assert (good >= t).mean() >= pii.RECALL - 1 / len(good)
            highest = np.sort(good)[int((1 - pii.RECALL) * len(good))]
            assert t <= highest and not ((bad >= t) & (bad < highest)).any()


def test_private_data_of_documents(spark, documents, trees):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.redact_pii(documents, trees).collect():
        for pattern in (r"[\w.+-]+@[\w-]+\.\w+", r"\+\d+ \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r'token = "[0-9a-f]{40}', r"\b\d{16}\b"):
            assert not re.search(pattern, r.text), (pattern, r.doc_id)
        spans = trees.redactions([texts[r.doc_id]])[0]
        want, at = "", 0
        for s, e, k in spans:
            want, at = want + texts[r.doc_id][at:s] + f"[{k}]", e
        assert r.text == want + texts[r.doc_id][at:] and r.n_redacted == len(spans)


def test_candidates_do_not_depend_on_anchors():
    for text, _ in pii.examples(300, seed=5):
        long = "word " * 60 + text + " word" * 60
        every = set()
        for k, (kind, p) in enumerate(pii._GENERATORS):
            for m in p.finditer(long):
                s, e = m.span(1) if kind == "SECRET" else m.span()
                while e > s and long[e - 1] in ".,;:)-" and kind != "SECRET":
                    e -= 1
                every.add((s, e, k))
        assert set(pii.candidates(long)) == every


def test_wide_forms_are_private_as_narrow_ones_are(trees):
    wide = {c: chr(ord(c) + 0xFEE0) for c in "0123456789@=:-+()"}
    arabic = {c: chr(0x660 + int(c)) for c in "0123456789"}
    texts = [t for t, _ in pii.examples(400, seed=6)]
    narrow = trees.redactions(texts)
    for table in (wide, arabic):
        assert [pii.candidates(t.translate(str.maketrans(table))) for t in texts] == [pii.candidates(t) for t in texts]
        assert trees.redactions([t.translate(str.maketrans(table)) for t in texts]) == narrow
    rows = ["tel ０９０-１２３４-５６７８ x", "card ４１１１ １１１１ １１１１ １１１１ x", "password：hunter4821 x", "é x"]
    text, count = pii._redact(trees, pa.array(rows))
    assert count.tolist() == [1, 1, 1, 0] and not re.search("[０-９]|hunter", " ".join(text.to_pylist()))


def test_private_data_of_odd_rows(spark, trees):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(70, "a " * 50_000 + "jo@mail1.example.com", "en", "s", None, "c", 1)], odd_docs(spark).schema))
    got = pii.redact_pii(docs, trees).collect()
    assert len(got) == len(ODD) * 2 + 1 and next(r.text for r in got if r.doc_id == 70).endswith("[EMAIL]")
    assert sorted((r.text is None) for r in got).count(True) == 2 and all(r.n_redacted == 0 for r in got if not r.text)
    whole = pii.redact_column(docs, trees)
    assert whole.columns == docs.columns and whole.filter("n_chars <> char_length(text)").count() == 0 and whole.count() == len(got)
    assert pii.redact_pii(docs.limit(0), trees).collect() == []


def test_toxic_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("toxic IS NOT NULL")
    docs = docs.join(known, "doc_id", "left_semi").cache()
    model = toxicity.fit_on(docs, known.filter("doc_id % 3 > 0"))
    got = toxicity.score_toxicity(docs, model).join(known.filter("doc_id % 3 = 0").select("doc_id", "toxic"), "doc_id").toPandas()
    right = got.is_toxic == (got.toxic == 1)
    assert right[got.toxic == 1].mean() > 0.85 and right[got.toxic == 0].mean() > 0.98


@pytest.mark.parametrize("sf, caught, clean", [("sf0.001", 0.0, 0.85), ("sf0.01", 0.35, 0.85)])
def test_toxic_documents_held_out_of_small_tables(spark, sf, caught, clean):
    """What a few hundred labels allow: README has the figures."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("toxic IS NOT NULL")
    model = toxicity.fit_on(docs, known.filter("doc_id % 3 > 0"))
    got = toxicity.score_toxicity(docs, model).join(known.filter("doc_id % 3 = 0").select("doc_id", "toxic"), "doc_id").toPandas()
    right = got.is_toxic == (got.toxic == 1)
    assert right[got.toxic == 1].mean() >= caught and right[got.toxic == 0].mean() >= clean


@pytest.mark.parametrize("seed", range(20))
def test_threshold_of_least_cost(seed):
    """No cut anywhere costs less than the one chosen."""
    rng = np.random.default_rng(seed)
    y = (rng.random(30) < 0.3).astype(int)
    y[:2] = 0, 1
    scores = np.round(rng.normal(size=30) + y, int(rng.integers(0, 3)))
    cost = lambda t: ((scores <= t) & (y > 0)).sum() / ((y > 0).sum() + toxicity.SMOOTH) + toxicity.FALSE_COST * ((scores > t) & (y == 0)).sum() / ((y == 0).sum() + toxicity.SMOOTH)
    t = toxicity.best_threshold(scores, y)
    assert cost(t) == pytest.approx(min(cost(v) for v in [scores.min() - 1, *scores])) and t not in scores


def test_thresholds_by_language():
    """A language with enough of both classes held out has its own threshold, found on those alone."""
    rng = np.random.default_rng(3)
    texts, y, langs = [], [], []
    for i in range(440):
        bad = i % 3 == 0
        lang = "ab"[int(rng.integers(2))] if i < 430 else "c"
        texts.append(" ".join(f"{lang}{rng.integers(40)}" for _ in range(12)) + (f" vile{lang}" if bad else ""))
        y.append(int(bad))
        langs.append(lang if i % 50 else None)
    y = np.array(y)
    m = toxicity.fit(texts, y, langs, epochs=1)
    order = np.argsort(-y, kind="stable")
    held = np.zeros(len(y), bool)
    held[order[3::4]] = True
    raw, offsets, _ = B.text_buffers(pa.array([t for t, h in zip(texts, held) if h]))
    scores = m.score(raw, offsets)
    assert m.threshold == toxicity.best_threshold(scores, y[held])
    own = {k: np.array([x == k for x, h in zip(langs, held) if h]) for k in "abc"}
    enough = {k for k, o in own.items() if min(y[held][o].sum(), (1 - y[held][o]).sum()) >= toxicity.LEAST_HELD_OUT}
    assert set(m.thresholds) == enough and len(enough) == 2 and "c" not in enough
    assert all(m.thresholds[k] == toxicity.best_threshold(scores[own[k]], y[held][own[k]]) for k in enough)
    assert m.limit(None) == m.limit("zz") == m.threshold


def test_every_labelled_document_is_learned_from(spark):
    """Insults of which each is in few of very many documents: a sample holds too few of each."""
    word = lambda kind, n: F.substring(F.md5(F.concat(F.lit(kind), (F.col("half") % n).cast("string"))), 1, 8)
    rows = spark.range(14_000).withColumns({"toxic": (F.col("id") % 2).cast("int"), "half": F.floor(F.col("id") / 2)})
    text = F.concat_ws(" ", word("a", 40), word("b", 50), F.when(F.col("toxic") == 1, word("vile", 700)).otherwise(word("mild", 700)))
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), "toxic").cache()
    model = toxicity.fit_on(docs.select("doc_id", "text", "lang"), docs.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs, model).join(docs, "doc_id").groupBy("toxic").agg(F.avg(F.col("is_toxic").cast("int"))).collect()
    assert dict(map(tuple, got))[1] > 0.9 and dict(map(tuple, got))[0] < 0.05


def test_training_by_units_is_the_mean_of_what_they_change(spark, monkeypatch):
    """Counts are of all units, a round's change of a row is the mean over those that change it, thresholds are of all that are held out."""
    for name, x in (("DRIVER_DOCS", 0), ("UNIT_DOCS", 250), ("LEAST_STEPS", 0)):
        monkeypatch.setattr(toxicity, name, x)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, int(rng.integers(0, 30)))) + (f" vile{i % 7}" if i % 3 == 0 else ""), ["de", "en", None][i % 5 % 3], int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    again = spark.createDataFrame([(r[0], "~ another text", None) for r in rows[:50]], "doc_id long, text string, lang string")  # "~" sorts behind all other texts
    docs = df.select("doc_id", "text", "lang").union(again).repartition(5)
    got = toxicity.fit_on(docs, df.select("doc_id", "toxic").union(df.select("doc_id", "toxic")), epochs=2)
    units = {}
    for r in df.withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.lit(4))).orderBy("doc_id").collect():
        units.setdefault(r.unit, []).append(r)
    cut = {k: toxicity.held_out(np.array([r.toxic for r in rs])) for k, rs in units.items()}
    split = lambda side: {k: [r for r, h in zip(rs, cut[k]) if h == side] for k, rs in units.items()}
    trained, held = split(False), [r for rs in split(True).values() for r in rs]
    words = {k: toxicity.hashed(pa.array([r.text for r in rs])) for k, rs in trained.items()}
    labels = {k: np.array([r.toxic for r in rs]) for k, rs in trained.items()}
    n = sum(map(len, labels.values()))
    known = sum(toxicity.documents_with(*w) for w in words.values()) >= toxicity.least_docs(n)
    state = toxicity.State.new(np.random.default_rng(toxicity.SEED))
    for turn in range(2):
        changes = []
        for k in units:
            own = copy.deepcopy(state)
            own.epoch(np.random.default_rng([toxicity.SEED, turn, k]), *words[k], labels[k], toxicity.class_weights(labels[k], sum(x.sum() for x in labels.values()) / n), known)
            changes.append(own.packed().astype(float) - state.packed())
        changed = np.sum([c.any(axis=1) for c in changes], axis=0)
        changed[known.size :] = len(units)
        state.add(np.sum(changes, axis=0) / np.maximum(changed, 1)[:, None])
    assert len(units) == 4 and 0 < known.sum() < known.size
    assert np.allclose(got.tables, state.model.tables, atol=1e-4) and np.allclose(got.out, state.model.out, atol=1e-4) and got.out_bias == pytest.approx(state.model.out_bias, abs=1e-4)
    raw, offsets, _ = B.text_buffers(pa.array([r.text for r in held]))
    scores, y = got.score(raw, offsets), np.array([r.toxic for r in held])
    assert got.threshold == pytest.approx(toxicity.best_threshold(scores, y), abs=1e-4) and set(got.thresholds) == {"de", "en"}
    for k, t in got.thresholds.items():
        own = np.array([r.lang == k for r in held])
        assert t == pytest.approx(toxicity.best_threshold(scores[own], y[own]), abs=1e-4)


def test_training_by_units_takes_one_worker_for_each_task(spark, monkeypatch):
    """No stage has two Python functions one after the other, nor Python rows: each would be one more worker, and workers stay."""
    for name, x in (("DRIVER_DOCS", 0), ("LEAST_STEPS", 0)):
        monkeypatch.setattr(toxicity, name, x)
    plans = []
    kept = toxicity.materialise
    monkeypatch.setattr(toxicity, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    made = type(spark).createDataFrame
    rows = [(i, f"word {'vile' if i % 3 == 0 else 'fine'} w{i}", "de", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    given = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *more, **named: given.append(type(data)) or made(self, data, *more, **named))
    toxicity.fit_on(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"), epochs=1)
    assert len(plans) == 2 and given and set(given) == {pa.Table}
    for plan in plans:
        assert "MapInArrow" in plan
        for stage in plan.split("Exchange"):
            assert all(part.count("MapInArrow") <= 1 for part in stage.split("Union"))


def test_a_worker_gives_back_what_it_has_freed():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pins = []

    def run(batches):
        for batch in batches:
            blocks = [bytearray(3000) for _ in range(40_000)]
            pins.append(bytearray(3000))  # the heap's last block stays, so that its end can't be cut off
            del blocks
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    list(run([batch]))
    before = held()
    assert list(store.trimmed(run)([batch])) == [batch]
    assert before - held() > 60 << 20
    with pytest.raises(ZeroDivisionError):
        list(store.trimmed(lambda batches: (1 // 0 for _ in batches))([batch]))


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_thresholds_of_many_scores_are_those_of_few(spark, digits):
    rng = np.random.default_rng(digits)
    y = (rng.random(400) < 0.3).astype(int)
    scores = np.round(rng.normal(size=400) * 3 + y * 2, digits).astype(np.float32)
    langs = [["de", "en", "fr", "", None][int(k)] for k in rng.integers(0, 5, 400)]
    df = spark.createDataFrame([(a, float(b), int(c)) for a, b, c in zip(langs, scores, y)], "lang string, score float, y int")
    want = {k: np.array([k in ("", x) for x in langs]) for k in ("", "de", "en", "fr")}
    assert toxicity.thresholds(df) == {k: (toxicity.best_threshold(scores[o].astype(float), y[o]), int(y[o].sum()), int((1 - y[o]).sum())) for k, o in want.items()}
    assert toxicity.thresholds(df.limit(0)) == {}


def test_hashed_words_score_as_their_text(monkeypatch):
    texts = ["", "some words and a vile one", "long " * 3000 + "vile end", "x"] * 3
    model = toxicity.train(["a vile text", "a good text"] * 20, np.array([1, 0] * 20), epochs=1)
    raw, offsets, _ = B.text_buffers(pa.array(texts))
    for chunk in (toxicity.CHUNK, 800):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(model.score_hashed(*toxicity.hashed(pa.array(texts))), model.score(raw, offsets), atol=1e-5)


def test_one_step_of_training_is_the_gradient(monkeypatch):
    """The change of the output's bias after one step is the mean error's, and the loss's slope found by differences."""
    monkeypatch.setattr(toxicity, "DROPPED", 0.0)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 0)
    texts, y = [f"w{i % 5} x{i % 3} bad" if i % 2 else f"w{i % 5} good" for i in range(24)], np.array([i % 2 for i in range(24)])
    start = toxicity.Model.new(np.random.default_rng(toxicity.SEED))
    got = toxicity.train(texts, y, epochs=1)
    raw, offsets, _ = B.text_buffers(pa.array(texts))

    def loss(model):
        z = model.score(raw, offsets)
        w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean())

    slope = (loss(dataclasses.replace(start, out_bias=start.out_bias + 1e-4)) - loss(dataclasses.replace(start, out_bias=start.out_bias - 1e-4))) / 2e-4
    assert got.out_bias == pytest.approx(start.out_bias - 0.1 * slope, abs=1e-4)
    for k in range(len(start.out)):  # the first step of each weight is its gradient's sign times the rate
        up, down = start.out.copy(), start.out.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        d = loss(dataclasses.replace(start, out=up)) - loss(dataclasses.replace(start, out=down))
        if abs(d) > 1e-6:
            assert got.out[k] - start.out[k] == pytest.approx(-0.01 * np.sign(d), abs=1e-4)
    assert loss(got) < loss(start)


def test_long_text_is_scored_by_segments(monkeypatch, spark, documents):
    model = toxicity.fit_on(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    raw, offsets, _ = B.text_buffers(pa.array([" ".join(r.text for r in documents.limit(12).collect()).lower(), "x" * 20_000 + " y", "a b"]))
    whole = model.score(raw, offsets)
    monkeypatch.setattr(toxicity, "CHUNK", 500)
    assert np.allclose(model.score(raw, offsets), whole, atol=1e-5) and len(list(B.segments(raw[: offsets[1]], 500, 2))) > 20


def test_a_score_at_its_threshold_is_not_toxic(spark):
    model = toxicity.Model.new(np.random.default_rng(0))
    model.out[:] = 0
    model.threshold = model.out_bias
    df = spark.createDataFrame([(1, "any", "en"), (2, "", None)], "doc_id long, text string, lang string")
    assert not any(r.is_toxic for r in toxicity.score_toxicity(df, model).collect()) and toxicity.drop_toxic(df, model).count() == 2


def test_toxicity_scores_do_not_depend_on_neighbours(spark, documents):
    model = toxicity.fit_on(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in documents.limit(40).collect()]
    lower = lambda xs: B.text_buffers(pc.utf8_lower(pa.array(xs)))[:2]
    assert np.allclose(model.score(*lower(texts)), [model.score(*lower([t]))[0] for t in texts], atol=1e-4)
    # by the definition: for each filter the greatest of its products with every run of embedded words
    raw, offsets = lower(["some words and three more"])
    buckets, words = toxicity.word_buckets(raw, offsets)
    x = np.stack([sum(model.tables[t, buckets[t, w]] for t in range(len(model.tables))) for w in range(words[0])] + [np.zeros(toxicity.DIM)] * 2)
    top = [max(0, max((x[i : i + w] * f[:, :, k]).sum() + b[k] for i in range(words[0]))) for w, f, b in zip(toxicity.WIDTHS, model.filters, model.bias) for k in range(toxicity.FILTERS)]
    assert model.score(raw, offsets)[0] == pytest.approx(float(np.array(top) @ model.out + model.out_bias), abs=1e-3)


def test_words_of_a_small_sample_are_learned():
    texts = [f"the house number{i} is near {'scumbag' if i % 10 == 0 else 'water'}" for i in range(40)]
    model = toxicity.train(texts, np.array([int(i % 10 == 0) for i in range(40)]), epochs=1)
    raw, offsets, _ = B.text_buffers(pa.array(["scumbag", "water"]))
    assert (np.abs(model.tables[0, toxicity.word_buckets(raw, offsets)[0][0]]).sum(axis=1) > 0).all()
    assert [toxicity.least_docs(n) for n in (10, 299, 300, 5000)] == [2, 2, 3, 6]


def test_toxicity_of_odd_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_on(documents, labels.union(labels))
    docs = odd_docs(spark)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(ODD) * 2 and sum(r.toxic_score is None for r in got) == 2 and not any(r.is_toxic for r in got if r.toxic_score is None)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).filter("text IS NULL").count() == 2
    nothing = toxicity.fit_on(docs.limit(0), labels.limit(0))
    assert not any(r.is_toxic for r in toxicity.score_toxicity(docs, nothing).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


TURN = st.tuples(st.none() | st.text(max_size=8), st.none() | st.text(alphabet=st.sampled_from(list("<|\\>\nend a%~!")), max_size=25) | st.text(max_size=10))


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_chat_round_trip(turns):
    text, escaped = chatformat.round_trip(turns)
    assert chatformat.parse(text) == turns and escaped <= len(turns)


def test_chat_escapes_only_what_conflicts():
    assert chatformat.round_trip([("user", "plain"), ("user", "<|end|>\n<|user|>\nx")])[1] == 1
    for bad in ("x", "<|user|>\nabc", "<|user!|>\nabc<|end|>\n"):
        with pytest.raises(chatformat.FormatError):
            chatformat.parse(bad)


def test_chat_query(spark):
    assert_same(spark, queries.op7_chat_format, queries.ORACLE_SQL["op7_chat_format"])


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", None, 9), (1, 0, "user", None, 9), (1, 1, None, "", 9), (None, None, "a", "<|x|>", 9), (2, 1, "b", "y" * 50_000, 9), (2, 1, "a", "z", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _t int")
    alone = [r.n_turns for r in chatformat.format_chats(df.unionAll(df.filter("conv_id IS NULL"))).collect() if r.conv_id is None]
    assert alone == [1, 1]
    got = {r.conv_id: r for r in chatformat.format_chats(df).collect()}
    assert chatformat.parse(got[1].rendered) == [("user", None), ("user", None), (None, "")] and got[None].n_escaped == 1
    assert [r for r, _ in chatformat.parse(got[2].rendered)] == ["a", "b"] and chatformat.format_chats(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_language_id", "op4_pii", "op8_toxicity"])
def test_every_document_is_answered(spark, documents, name):
    assert queries.QUERIES[name](spark, SF).agg(F.count_distinct("doc_id")).first()[0] == documents.count()
