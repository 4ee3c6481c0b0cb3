"""Joins, audio, packing, mixing and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, assert_same, connect
from pyspark.sql import functions as F

from spanloom.llm import audio, bytesops, graph, gridjoin, mixing, ngramjoin, packing, queries


ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def grams(text, n=3):
    w = regex.findall(r"[\p{L}\p{M}\p{N}_]+", regex.sub(f"({ALONE})", r" \1 ", text.lower()))
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab_9 .é—“ü\u3000。、北京カないไทยក๑\u0301😀ª")), max_size=12), max_size=5))
def test_words_are_those_of_the_pattern(texts):
    raw, offsets, _ = bytesops.text_buffers(pa.array(texts, pa.string()))
    start, length, doc = bytesops.word_spans(raw, offsets)
    got = [[] for _ in texts]
    for s, n, d in zip(start, length, doc):
        got[d].append(bytes(raw[s : s + n]).decode())
    assert got == [regex.findall(r"[\p{L}\p{M}\p{N}_]+", regex.sub(f"({ALONE})", r" \1 ", t)) for t in texts]


def test_near_copies_without_spaces(spark):
    text = "日本語の文書には空白がありませんので、一文字ずつを単語として数えます。"
    rows = [(1, text), (2, text.replace("、", "\u3000").replace("数え", "考え")), (3, "まったく別の文章です。"), (4, "«one two, three four five»"), (5, "one two three… “four” five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(df) == brute_links(rows) and linked(df)[2, 1, 1] == 1 and linked(df)[5, 4, 1] == 1


def brute_links(rows, threshold=0.5):
    """(id, least id of the group, links) of each distinct pair of an id and a set, by comparing all with all."""
    nodes = sorted({(i, frozenset(grams(t or ""))) for i, t in rows if i is not None}, key=lambda x: (x[0], sorted(x[1])))
    near = [[y for y, (_, h) in enumerate(nodes) if x != y and g and h and len(g & h) >= threshold * len(g | h)] for x, (_, g) in enumerate(nodes)]
    root = list(range(len(nodes)))
    edges = [(x, y) for x, ys in enumerate(near) for y in ys] + [(x, x + 1) for x in range(len(nodes) - 1) if nodes[x][0] == nodes[x + 1][0]]
    for _ in nodes:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    return Counter((i, nodes[root[x]][0], len(near[x])) for x, (i, _) in enumerate(nodes))


def noisy(seed, docs=30, copies=4, words=80):
    r = random.Random(seed)
    rows = []
    for _ in range(docs):
        base = [f"w{r.randrange(4000)}" for _ in range(words)]
        for c in range(r.randrange(1, copies + 1)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6]) if c else 0):
                t[r.randrange(words)] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    return rows


def linked(df, **kw):
    return Counter(tuple(r) for r in ngramjoin.ngram_jaccard_join(df, **kw).collect())


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_no_link_is_lost(spark, threshold):
    rows = noisy(1)
    assert linked(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold) == brute_links(rows, threshold)


def alike(n=40):
    """A group in which all share much, and each pair something else."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    return [(i, " ".join(w if r.random() > 0.06 else f"n{r.randrange(9)}" for w in base)) for i in range(n)] + [(100 + i, f"other {i} text " * 9) for i in range(9)]


@pytest.mark.parametrize("block, frequent, part_grams, small", [(2048, 1 << 15, 1 << 21, 64), (7, 1 << 15, 200, 2), (7, 17, 200, 64), (2048, 17, 1 << 21, 1)])
def test_cells_blocks_and_frequent_grams(spark, block, frequent, part_grams, small):
    rows = alike()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    join = ngramjoin.Join(df, "doc_id", "text", 3, 0.5, block, frequent, part_grams, small)
    assert (join.holders is not None and len(join.holders) > 20) == (frequent < 40)
    # a group that meets under many n-grams is a few cells
    assert join.cells.groupBy("cell").count().filter("count > 1").count() < 15
    first = {r.c: r.first for r in join.classes.collect()}
    got = Counter(tuple(sorted((first[r.a], first[r.b]))) + (round(r.jaccard, 6),) for r in join.pairs().collect())
    sets = [(i, grams(t)) for i, t in rows]
    want = Counter((i, j, round(len(x & y) / len(x | y), 6)) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if x != y and len(x & y) >= 0.5 * len(x | y))
    assert got == want and len(want) > 100
    assert Counter((r.c, r.links) for r in join.linked().collect()) == Counter({(c, sum(f in p[:2] for p in want)): 1 for c, f in first.items() if any(f in p[:2] for p in want)})


def test_ngram_query(spark):
    assert_same(spark, queries.op2_ngram_jaccard_join, queries.ORACLE_SQL["op2_ngram_jaccard_join"])


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_count_tree_loses_nothing(threshold):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(90):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for _ in range(5):
            keep = rng.random(60) < rng.choice([0.95, 0.7, 0.4])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int((~keep).sum()), dtype=np.uint64)])))
    got = {(min(a, b), max(a, b), o) for a, b, o in zip(*(x.tolist() for x in ngramjoin.join_sets(sets, threshold)))}
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            if o >= threshold * (len(sets[a]) + len(sets[b]) - o) - 1e-9:
                want.add((a, b, o))
    assert got == want and want


def brute_keep(rows):
    gone = {i for i, least, _ in brute_links(rows) if least != i}
    return sorted((i is None, i or 0) for i, _ in rows if i not in gone)


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, t in noisy(2) if True] + [(900 + k, "the very same text again") for k in range(40)] + [(None, "the very same text again"), (950, None), (951, ""), (952, "!!"), (953, "!!"), (900, "the very same text again")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, id int")
    out = ngramjoin.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == brute_keep(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}


def test_ngram_join_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A, b. C d"), (3, "a b"), (4, "A B!"), (5, None), (None, "a b c d"), (6, ""), (7, "..."), (8, "lang " * 30_000), (9, "lang " * 30_000)]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, bands binary")
    assert linked(df) == brute_links(rows) and linked(df)[8, 8, 1] == 1
    assert linked(df.limit(0)) == Counter() and ngramjoin.keep_one(df.limit(0)).collect() == [] and linked(df.filter("text IS NULL OR text = ''")) == Counter({(5, 5, 0): 1, (6, 6, 0): 1})


def test_an_id_with_several_texts(spark):
    rows = [(5, "a b c d e f g h"), (5, "q r s t u v"), (5, None), (2, "q r s t u v"), (3, "a b c d e f g i"), (7, ""), (9, "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int")
    assert linked(df) == brute_links(rows)
    assert sorted(r.doc_id for r in ngramjoin.keep_one(df).collect()) == [2, 7, 9]


def test_g711_tables():
    def mulaw(u):
        u = ~u & 0xFF
        x = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
        return -x if u & 128 else x

    def alaw(a):
        a ^= 0x55
        e, m = a >> 4 & 7, a & 15
        x = (m << 4) + 8 if e == 0 else ((m << 4) + 264) << (e - 1)
        return x if a & 128 else -x

    assert audio.mulaw_table().tolist() == [mulaw(u) for u in range(256)] and audio.alaw_table().tolist() == [alaw(a) for a in range(256)]
    assert audio.mulaw_table().min() == -32124 and audio.alaw_table().max() == 32256


def brute_adpcm(raw, block):
    out = []
    for at in range(0, len(raw), block):
        b = raw[at : at + block]
        if len(b) < 4:
            break
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.step_table()[index])
                diff = step >> 3
                diff += step if code & 4 else 0
                diff += step >> 1 if code & 2 else 0
                diff += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
    return out


def test_adpcm_against_one_sample_at_a_time():
    rng = np.random.default_rng(4)
    payloads = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 3, 4, 5, 256, 257, 259, 260, 1000)]
    raw, offsets, _ = bytesops.text_buffers(pa.array(payloads, pa.binary()))
    got, n = audio.decode_adpcm(raw, offsets[:-1], np.diff(offsets))
    want = [brute_adpcm(p, audio.BLOCK) for p in payloads]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)])
def test_resampling_against_the_sum(rates):
    rng = np.random.default_rng(5)
    parts = [rng.integers(-9000, 9000, n).astype(np.int16) for n in (0, 1, 7, 50)]
    got, n = audio.resample(np.concatenate(parts), np.array([len(p) for p in parts]), *rates)
    g = math.gcd(*rates)
    up, down = rates[1] // g, rates[0] // g
    want = []
    for p in parts:
        out = math.ceil(len(p) * up / down)
        if up == down:
            want += p.tolist()
            continue
        h = audio.filter_phases(up, down)
        for j in range(out):
            phase, at = j * down % up, j * down // up
            s = sum(float(h[phase, k]) * float(p[at + k - (audio.TAPS // 2 - 1)]) for k in range(audio.TAPS) if 0 <= at + k - (audio.TAPS // 2 - 1) < len(p))
            want.append(max(-32768, min(32767, round(s))))
    assert n.sum() == len(want) == len(got) and np.abs(got - np.array(want)).max(initial=0) <= 1


def test_a_tone_stays_a_tone():
    t = np.arange(4000)
    x = np.rint(8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    y, _ = audio.resample(x, np.array([len(x)]), 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 80


def test_audio_of_odd_rows(spark):
    rows = [(1, b"\x00\xff" * 500, "mulaw", 1), (1, b"", "alaw", 1), (2, None, "mulaw", 1), (None, b"abcd", None, 1), (3, b"abcd", "opus", 1), (4, b"\x01" * 700_000, "adpcm", 1)]
    df = spark.createDataFrame(rows, "id long, payload binary, codec string, pcm int")
    got = sorted(((r.id or 0, r.codec or "", r.n_samples, None if r.pcm is None else len(r.pcm)) for r in audio.decode_telephony(df).collect()), key=str)
    n4 = len(brute_adpcm(b"\x01" * 700_000, audio.BLOCK)) * 2
    assert got == sorted([(0, "", None, None), (1, "alaw", 0, 0), (1, "mulaw", 2000, 4000), (2, "mulaw", None, None), (3, "opus", None, None), (4, "adpcm", n4, 2 * n4)], key=str)
    assert audio.decode_telephony(df.limit(0)).collect() == []
    assert queries.op5_telephony_audio(spark, SF).filter("n_samples * 2 = length(pcm)").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def brute_near(rows, eps):
    """(id, least id of the group, links) of each distinct pair of an id and a vector."""
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    nodes = sorted({(i, tuple(v) if good(v) else None) for i, v in rows if i is not None}, key=str)
    near = [[y for y, (_, w) in enumerate(nodes) if x != y and v and w and len(v) == len(w) and math.dist(v, w) <= eps] for x, (_, v) in enumerate(nodes)]
    root = [i for i, _ in nodes]
    edges = [(x, y) for x, ys in enumerate(near) for y in ys] + [(x, y) for x in range(len(nodes)) for y in range(x) if nodes[x][0] == nodes[y][0]]
    for _ in nodes:
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    return Counter((i, root[x], len(near[x])) for x, (i, _) in enumerate(nodes))


def near(df, *a, **kw):
    return Counter(tuple(r) for r in gridjoin.embedding_near_join(df, *a, **kw).collect())


@pytest.mark.parametrize("range_rows, fan", [(8192, 32), (20, 2)])
def test_near_vectors_are_all_found(spark, range_rows, fan):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12)) * 0.3
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:20]])
    ids = [int(i) for i in rng.permutation(len(x))]
    ids[5] = ids[6]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_near(rows, 0.25)
    assert near(df, 0.25, range_rows=range_rows, fan=fan) == want and sum(n for *_, n in want.elements()) > 120
    members, pairs = gridjoin.embedding_near_pairs(df, 0.25, range_rows=range_rows, fan=fan)
    of = {}
    for r in members.collect():
        of.setdefault(r.c, []).append(r.vec_id)
    links = sum(2 * len(of[r.a]) * len(of[r.b]) for r in pairs.collect()) + sum(len(m) * (len(m) - 1) for m in of.values())
    assert links == sum(n for *_, n in want.elements())


@pytest.mark.parametrize("name", ["op6_embedding_near_pairs", "op6_embedding_near_wide"])
def test_near_vectors_query(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF.replace("0.001", "0.01"))
    if name.endswith("wide"):
        assert queries.QUERIES[name](spark, SF.replace("0.001", "0.01")).filter("n_links > 0").count() > 50


def test_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [-0.0, 0.0]), (2, [0.0, 0.1]), (2, [0.0, 0.1]), (3, None), (4, []), (5, [0.0]), (6, [nan, 0.0]), (7, [None, 0.0]), (7, [9.0, 9.0]), (None, [0.0, 0.0]), (8, [float("inf"), 0.0]), (9, [5.0, 5.0]), (11, [5.25, 5.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, part int, c string")
    got = near(df)
    assert got == Counter({(1, 1, 2): 1, (2, 1, 2): 2, (3, 3, 0): 1, (4, 4, 0): 1, (5, 5, 0): 1, (6, 6, 0): 1, (7, 7, 0): 2, (8, 8, 0): 1, (9, 9, 1): 1, (11, 9, 1): 1})
    assert near(df.limit(0)) == Counter() and near(df.filter("vec_id = 3")) == Counter({(3, 3, 0): 1})


def test_a_longer_vector_removes_no_pairs(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, [0.0, 0.0, 0.0]), (4, [5.0]), (5, [5.1]), (6, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert near(df) == brute_near(rows, 0.25)


def brute_best_fit(lengths, capacity):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(open_) if r >= n]
        k = min(fit, key=lambda k: open_[k]) if fit else len(open_)
        if not fit:
            open_.append(capacity)
        open_[k] -= n
    return Counter(open_)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 37, 100]))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400))) if seed else np.zeros(0, int)
    counts = dict(Counter(lengths.tolist()))
    plan = packing.plan_windows(counts, capacity)
    used = Counter()
    places = []
    for n, many in counts.items():
        window, offset = plan.place(np.full(many, n), np.arange(many))
        places += [(int(w), int(o), n) for w, o in zip(window, offset)]
        for w in window.tolist():
            used[w] += n
    assert Counter(capacity - u for u in used.values()) == brute_best_fit(lengths.tolist(), capacity) and sorted(used) == list(range(plan.windows))
    places.sort()
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


@pytest.mark.parametrize("bucket_rows", [1, 2, 50_000])
def test_packing_places_every_token_once(spark, bucket_rows):
    rows = [(1, 5), (1, 5), (2, 23), (3, 0), (4, None), (None, 7), (5, 10), (6, 10), (7, 3), (8, 20), (8, 20), (8, 21), (9, 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, n long, text string, length int, rows int")
    got = packing.pack(df, capacity=10, tokens_col="n", bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.token_start, r.n_tokens) for r in got) == Counter((i, s, min(10, n - s)) for i, n in rows for s in range(0, n or 0, 10))
    pieces = [min(10, n - s) for _, n in rows for s in range(0, n or 0, 10)]
    assert max(r.window_id for r in got) + 1 == sum(brute_best_fit(pieces, 10).values())
    at = sorted((r.window_id, r.window_offset, r.n_tokens) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(at, at[1:])) and len({x[:2] for x in at}) == len(at)
    assert packing.pack(df.limit(0), tokens_col="n").collect() == [] and packing.pack(df.limit(0)).collect() == []


def brute_mix(rows, schedules, run):
    """Positions found by stepping through training."""
    by = {}
    for i, s, n, o in rows:
        by.setdefault(s or "", []).append((o, i, n))
    out = []
    for s, docs in by.items():
        supply = sum(n for *_, n in docs)
        if s not in schedules or not supply:
            continue
        xs = np.linspace(0, 1, 20_001)
        w = np.interp(xs, *zip(*sorted(schedules[s])))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(xs))]) * run
        c, k = 0, 0
        while c < demand[-1] - 1e-9:
            for _, i, n in sorted(docs):
                if c < demand[-1] - 1e-9:
                    out.append((i, k, float(np.interp(c, demand, xs))))
                c += n
            k += 1
    return out


@pytest.mark.parametrize("bucket_tokens", [7, 1 << 22])
def test_mixing_against_stepping(spark, bucket_tokens):
    import hashlib

    rng = np.random.default_rng(8)
    rows = [(i, ["a", "b", None][int(rng.integers(3))], int(rng.integers(1, 60))) for i in range(150)]
    df = spark.createDataFrame([(i, "x" * (4 * n), s, 0.5) for i, s, n in rows], "doc_id long, text string, source string, position double")
    schedules = {"a": [(0.0, 0.7), (0.4, 0.2), (1.0, 0.5)], "b": [(0.0, 0.2), (1.0, 0.4)], "": [(0.0, 0.1), (0.4, 0.5), (1.0, 0.1)]}
    got = sorted((r.doc_id, r.epoch, r.position) for r in mixing.mix_sources(df, schedules, run_tokens=6000, bucket_tokens=bucket_tokens).collect())
    want = sorted(brute_mix([(i, s, n, hashlib.md5(str(i).encode()).hexdigest()) for i, s, n in rows], schedules, 6000))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-3)


def test_mixing_query(spark):
    assert_same(spark, queries.op10_mixing, queries.ORACLE_SQL["op10_mixing"])
    out = [r.position for r in queries.op10_mixing(spark, SF).select("position").collect()]
    assert out == sorted(out)


def test_mixing_by_counted_tokens(spark):
    """Texts of equal bytes and other tokens: demand is met in tokens."""
    import hashlib

    from spanloom.llm import tokencount

    texts = {"a": "the house is old " * 40, "b": "Straßenbähnchenübergänge " * 26}
    rows = [(i, texts["ab"[i % 2]], "ab"[i % 2]) for i in range(40)]
    df = tokencount.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = {r.doc_id: r.n_tokens for r in df.collect()}
    assert n == {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df).collect()} and n[1] > 1.3 * n[0]
    schedules = {"a": [(0.0, 0.5)], "b": [(0.0, 0.5)]}
    run = sum(n.values())
    got = sorted((r.doc_id, r.epoch, r.position) for r in mixing.mix_sources(df, schedules, tokens_col="n_tokens").collect())
    want = sorted(brute_mix([(i, s, n[i], hashlib.md5(str(i).encode()).hexdigest()) for i, _, s in rows], schedules, run))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-3)
    read = {s: sum(n[i] for i, *_ in got if "ab"[i % 2] == s) for s in "ab"}
    assert abs(read["a"] - read["b"]) < 2 * max(n.values())


def test_mixing_of_odd_rows(spark):
    rows = [(1, "aaaa" * 9, "s", 1), (1, "aaaa" * 9, "s", 1), (None, "bbbb", None, 1), (2, None, "s", 1), (3, "", "s", 1), (4, "c" * 100_000, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    got = mixing.mix_sources(df.withColumns({k: df.doc_id for k in ("_s", "_b", "_row", "_n", "_o", "_digits", "a.b")}))
    assert got.columns == ["doc_id", "text", "source", "_s", "_b", "_row", "_n", "_o", "_digits", "a.b", "position", "epoch"] and got.filter("doc_id = 4").count() >= 1
    assert mixing.mix_sources(df.limit(0)).collect() == [] and mixing.mix_sources(df.filter("text IS NULL OR text = ''")).collect() == []


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables: what each docstring says."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, "word " * 60_000, None, "", 300_000), (9003, None, "xx", "src1", None), (None, "some text of no id", "de", "src1", 18), (9004, "!!", "en", "src1", 2), (9005, "write to jo@mail1.example.com", "fr", "src1", 29), (9005, "write to jo@mail1.example.com", "fr", "src1", 29)]
    more = ("c", "n", "id", "task", "_s", "_row", "position", "epoch", "n_tokens", "_sl_text", "window_id", "cell", "gone")
    names = docs.columns

    def laid(df):
        return df.withColumns({k: F.lit(k) for k in more})

    full = laid(docs.unionByName(spark.createDataFrame(odd, kinds)))
    rows = lambda df: Counter(tuple(str(r[c]) for c in names) for r in df.collect())
    now = full
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == full.columns and out.filter(" OR ".join(f"{k} <> '{k}'" for k in more)).count() == 0
        got = rows(out)
        if name in ("toxicity", "near_copies"):
            some = [r for r in odd if name == "near_copies" or not r[1] or r[1] == "!!"]
            assert [r[:1] for r in some if got[tuple(str(x) for x in r)] != some.count(r)] == [] and not got - rows(now)
        elif name == "private":
            assert got["None", "None", "None", "None", "None"] == 1 and got["9001", "", "en", "None", "0"] == 2
            assert sum(n for r, n in got.items() if r[0] == "9005" and r[1] == "write to [EMAIL]" and r[4] == "16") == 2
        assert stage(spark, full.limit(0), SF).collect() == []
        # a classifier of 87 labels isn't held to anything else here
        now = full if name == "toxicity" else spark.createDataFrame(out.collect(), out.schema)
    pieces = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.collect()} >= {9002} and not {9001, 9003} & {r.doc_id for r in pieces.collect()} and P.STAGES[-1][1](spark, now.limit(0), SF).collect() == []


def test_pipeline_stages(spark):
    """Each stage against what its rule says of the stage before."""
    import corpus_pipeline as P
    from spanloom.llm import pii, tokencount, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs.toPandas(), []
    now = docs
    for _, stage in P.STAGES:
        now = stage(spark, now, SF)
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append(now.toPandas())
    model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).filter("is_toxic").collect()}
    assert set(kept[0].doc_id) == set(at.doc_id) - toxic and len(kept[0]) > 0.8 * len(at)
    rows = list(zip(kept[0].doc_id.tolist(), kept[0].text.tolist()))
    assert sorted((False, i) for i in kept[1].doc_id) == brute_keep(rows)
    trees, texts = pii.fit(), dict(zip(kept[1].doc_id, kept[1].text))
    for i, t, n in zip(kept[2].doc_id, kept[2].text, kept[2].n_chars):
        want, last = "", 0
        for s, e, k in trees.redactions([texts[i]])[0]:
            want, last = want + texts[i][last:s] + f"[{k}]", e
        assert t == want + texts[i][last:] and n == len(t)
    con = connect()
    counted = tokencount.count_tokens(spark.createDataFrame(kept[2], docs.schema)).toPandas()
    con.register("kept", kept[2].merge(counted, on="doc_id"))
    own = "CAST(ceil(strlen(text) / 4.0) AS BIGINT)"
    sql = queries.ORACLE_SQL["op10_mixing"]
    assert own in sql
    mixed = con.execute(sql.replace(own, "n_tokens").replace("FROM documents", "FROM kept")).df()
    assert Counter(kept[3].doc_id) == Counter(mixed.doc_id) and list(kept[3].columns) == list(docs.columns)
    assert kept[3].doc_id.tolist() == mixed.sort_values(["position", "epoch", "doc_id"]).doc_id.tolist()
    frame = spark.createDataFrame(kept[3], docs.schema)
    sizes = [r.n_tokens for r in tokencount.count_tokens(frame).collect()]
    pieces = [min(packing.CAPACITY, n - s) for n in sizes for s in range(0, n, packing.CAPACITY)]
    last = kept[4]
    assert Counter(last.n_tokens.tolist()) == Counter(pieces) and last.window_id.max() + 1 == sum(brute_best_fit(pieces, packing.CAPACITY).values())
    assert Counter(P.run(spark, SF).toPandas().doc_id) == Counter(last.doc_id)
