import dataclasses
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluate, forward
from spanloom.operators.bpe import byte_alphabet
from spanloom.operators.forward import Config
from spanloom.plans.engine import Engine
from spanloom.sources import files, gguf, sinks, synthetic

C = Config(2, 16, 4, 2, 8, 8, 4, 2, 3, 4096, 4096, 9)
W = forward.random_weights(C, 256, seed=1)
BIG = Config(8, 640, 14, 2, 64, 640, 128, 4, 128, 131072, 4096, 217, yarn_factor=32.0)
LABELS = ["O", *(f"{t}-{c}" for c in ("private_person", "secret") for t in "BIES")]


def test_yarn():
    f, scale = forward.yarn(BIG)
    assert scale == pytest.approx(0.1 * math.log(32) + 1) and scale == pytest.approx(1.3465735902799727)
    own = 150000.0 ** (-np.arange(32) / 32)
    assert f[0] == own[0] == 1 and f[-1] == pytest.approx(own[-1] / 32) and f[-1] == pytest.approx(3.0235113968e-07)
    assert (np.diff(f) < 0).all() and (f <= own + 1e-15).all() and (f >= own / 32 - 1e-15).all()
    assert forward.yarn(dataclasses.replace(BIG, yarn_factor=1.0))[1] == 1.0


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 300])
def test_mask(n):
    m = forward.band_mask(n, 128)
    assert all(m[a, b] == (abs(a - b) <= 128) for a in range(0, n, 37) for b in range(n))


def test_rope_turns_pairs():
    x = np.random.default_rng(0).normal(size=(5, 2, 8)).astype(np.float32)
    y = forward.rope(x, 150000.0 ** (-np.arange(4) / 4), 1.0)
    assert np.allclose(y[0], x[0]) and np.allclose(np.hypot(y[..., 0::2], y[..., 1::2]), np.hypot(x[..., 0::2], x[..., 1::2]), atol=1e-5)
    a = 3.0
    assert y[3, 0, 0] == pytest.approx(x[3, 0, 0] * math.cos(a) - x[3, 0, 1] * math.sin(a), abs=1e-5)


def test_swiglu_and_gating():
    g, u = np.array([-9.0, 0.5, 9.0]), np.array([-9.0, 0.5, 9.0])
    want = [(max(-7, min(7, b)) + 1) * min(a, 7) / (1 + math.exp(-1.702 * min(a, 7))) for a, b in zip(g, u)]
    assert np.allclose(forward.swiglu(g, u), want)
    best, w = forward.top_experts(np.array([[1.0, 3.0, 3.0, 2.0]]), 2)
    assert best.tolist() == [[1, 2]] and np.allclose(w, 0.5)


@pytest.mark.parametrize("n", [1, 5, 6, 7, 40])
def test_banded_is_full(n):
    rng = np.random.default_rng(n)
    q, k, v = (rng.normal(size=(n, h, 8)).astype(np.float32) for h in (4, 2, 2))
    s = rng.normal(size=4).astype(np.float32)
    assert np.allclose(forward.attention_full(q, k, v, s, 3), forward.attention_banded(q, k, v, s, 3), atol=1e-5)


def test_chunks_taps_and_ablation():
    ids = np.arange(30)
    taps = {}
    a = forward.forward(C, W, ids, taps)
    assert np.allclose(a, forward.forward(C, W, ids, moe_chunk=7), atol=1e-5) and np.allclose(a, forward.forward(C, W, ids, banded=True), atol=1e-4)
    assert {"embd", "l0.q_rope", "l1.moe_topk", "result_norm", "logits"} <= set(taps) and taps["l1.moe_topk"].shape == (30, 2)
    assert not np.allclose(a, forward.forward(C, W, ids, without="nomoe")) and forward.forward(C, W, np.zeros(0, int)).shape == (0, 9)


def engine(window=4096):
    from spanloom.operators.bpe import Vocabulary

    return Engine(vocabulary=Vocabulary({bytes([b]): b for b in range(256)}, {}), config=C, load=lambda: W, labels=tuple(LABELS), window=window, threshold=0.0)


def test_windowed_is_whole(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs away."), (2, "x"), (3, ""), (4, None)], "doc_id int, text string")
    want = {r.doc_id: forward.forward(C, W, np.frombuffer(r.text.encode(), np.uint8)) for r in docs.collect() if r.text}
    for window in (4096, 2 * C.halo + 5):
        got = engine(window).logits(docs).orderBy("doc_id", "tok_pos").collect()
        assert [(r.doc_id, r.tok_pos) for r in got] == [(d, k) for d, x in sorted(want.items()) for k in range(len(x))]
        assert np.allclose([r.logits for r in got], np.concatenate([want[1], want[2]]), atol=1e-4)
        assert np.allclose(np.exp([r.logp for r in got]).sum(axis=1), 1, atol=1e-5)
    a, b = (sorted((r.doc_id, s.start, s.end, s.label, round(s.score, 3)) for r in engine(w).classify(docs).collect() for s in r.entities or []) for w in (4096, 2 * C.halo + 5))
    assert a == b and a
    assert engine().redact(docs).filter("doc_id = 4 AND redacted IS NULL AND entities IS NULL").count() == 1


def test_repeated_and_null_ids(spark):
    """A row's spans are its own, whatever its id and whatever its columns are called."""
    texts = ["The quick brown fox jumps over", "x", "", None, "The quick", "a longer text, to be cut into several windows by the engine"]
    ids = ["a", "a", "a", "a", None, None]
    docs = spark.createDataFrame([(i, t, 5, "e") for i, t in zip(ids, texts)], "doc_id string, text string, tokens int, entities string")
    for window in (4096, 2 * C.halo + 5):
        got = engine(window).classify(docs).collect()
        assert list(got[0].asDict()) == ["doc_id", "text", "tokens", "entities"] and all((r.doc_id, r.tokens) in (("a", 5), (None, 5)) for r in got)
        alone = {t: engine(window).classify(spark.createDataFrame([(1, t)], "doc_id int, text string")).first().entities for t in texts}
        rounded = lambda e: None if e is None else [(x.start, x.end, x.label, round(x.score, 3)) for x in e]
        assert sorted(((r.text, rounded(r.entities)) for r in got), key=str) == sorted(((t, rounded(alone[t])) for t in texts), key=str)
        assert engine(window).redact(docs).count() == 6 and engine(window).classify_lenient(docs).filter("spans IS NULL").count() == 1
    assert engine().classify(docs.limit(0)).collect() == []


def test_windows_in_memory_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    from spanloom.operators.windows import windows

    for n in (1, 9, 10, 11, 25, 26, 27, 100):
        got = spark.range(1).select(windows(F.lit(n), 10, 3).alias("w")).first().w
        assert [tuple(w) for w in got] == forward.cut_windows(n, 10, 3)
    with pytest.raises(ValueError):
        forward.cut_windows(11, 10, 5)


def test_many_paths_are_single_paths():
    from spanloom.functions.labels import label_table
    from spanloom.operators import decode

    rng = np.random.default_rng(2)
    for labels in (LABELS, ["O"], [x for x in LABELS if x != "O"], ["O", "B-X", "I-X"], ["B-X", "I-X"]):
        table = label_table(labels)
        texts = [np.round(rng.normal(size=(n, len(labels))), 1).astype(np.float32) for n in (0, 1, 7, 3, 0, 40, 3, 1)]
        texts[2][1:3] = -np.inf
        got = decode.viterbi_many(table, texts)
        assert all(np.array_equal(a, decode.viterbi(table, x)) for a, x in zip(got, texts))


def test_lenient_mode(spark):
    docs = spark.createDataFrame([(1, "Ana né Bo, 12"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.spans for r in engine().classify_lenient(docs).collect()}
    assert got[3] is None and got[2] == []
    text = docs.first().text
    best = forward.forward(C, W, np.frombuffer(text.encode(), np.uint8)).argmax(axis=1)
    from spanloom.operators.decode import lenient_spans

    at = [i for i, c in enumerate(text) for _ in c.encode()]
    raw = lenient_spans([LABELS[k] for k in best], at, [i + 1 for i in at])
    assert bool(got[1]) == bool(raw) and all(0 <= s.start < s.end <= len(text) and s.label in ("private_person", "secret") for s in got[1])


def test_command_line(spark, capsys, tmp_path):
    import io

    from spanloom.__main__ import main

    assert main(["redact", "--labels"], io.StringIO("to a.b@mail1.example.com\n")) == 0 and capsys.readouterr().out == "to [EMAIL]\n"
    assert main(["classify"], io.StringIO('"a@b.example"')) == 0 and json.loads(capsys.readouterr().out)[0]["start"] == 1
    assert main([]) == 2 and main(["redact", "--nope"]) == 2 and main(["info"]) == 0
    assert main(["redact", str(tmp_path / "none.gguf")]) == 1


def test_gguf_round_trip(tmp_path, spark):
    path = str(tmp_path / "m.gguf")
    tokens = [chr(b) if 33 <= b < 127 else f"?{b}" for b in range(256)]
    tensors = dict(W) | {"cls.output.weight": W["cls.output.weight"].astype(np.float16)}
    gguf.write_gguf(path, gguf.metadata_of(C, LABELS, "toy") | {"tokenizer.ggml.tokens": tokens, "tokenizer.ggml.merges": ["a b"]}, tensors, q8=frozenset({"token_embd.weight"}))
    f = gguf.ModelFile(path)
    assert f.labels == LABELS and f.info()["labels"] == 9
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(dataclasses.astuple(f.config), dataclasses.astuple(C)))
    assert np.array_equal(f.tensor("blk.1.attn_q.weight"), W["blk.1.attn_q.weight"]) and f.tensor("none") is None
    assert np.abs(f.tensor("token_embd.weight") - W["token_embd.weight"]).max() < 0.05
    e = Engine.from_gguf(path, threshold=0.0)
    docs = spark.createDataFrame([(1, "ab cd ab")], "doc_id int, text string")
    assert e.classify(docs).count() == 1 and e.with_window(64).window == 64


@pytest.fixture
def model_file(tmp_path):
    tokens = [chr(b) if 33 <= b < 127 else next(c for c, k in byte_alphabet().items() if k == b) for b in range(256)]
    path = str(tmp_path / "toy.gguf")
    gguf.write_gguf(path, gguf.metadata_of(C, LABELS, "toy") | {"tokenizer.ggml.tokens": tokens, "tokenizer.ggml.merges": ["a b"]}, W)
    return path


def test_token_batch(model_file, tmp_path, spark):
    from spanloom.__main__ import main

    texts = [b"", b"ab cd", "é!".encode()]
    (tmp_path / "in").write_bytes(files.pack_texts(texts))
    assert main(["tok-batch", model_file, str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    want = files.parse_tokens((tmp_path / "out").read_bytes())
    assert [len(x) for x in want] == [0, 5, 3] and want[2][:2] == [(0xC3, 0, 2), (0xA9, 0, 2)]
    assert main(["tok-batch", model_file]) == 2 and main(["tok-batch", model_file, str(tmp_path / "none"), str(tmp_path / "x")]) == 1
    # the same by executors
    docs = Engine.from_gguf(model_file).tokenize(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)] + [(9, None)], "pos int, text string"))
    files.join_packs(files.write_token_packs(docs, str(tmp_path / "packs")), str(tmp_path / "joined"))
    assert files.parse_tokens((tmp_path / "joined").read_bytes()) == [*want, []]


def test_run_on_token_ids(model_file, tmp_path, capsys, spark):
    from spanloom.__main__ import main

    text = b" Ann went to town, and back again "
    ids = np.frombuffer(text, np.uint8).astype("<i4")
    (tmp_path / "ids").write_bytes(ids.tobytes())
    (tmp_path / "offsets").write_bytes(np.stack([np.arange(len(ids)), np.arange(1, len(ids) + 1)], axis=1).astype("<i4").tobytes())
    (tmp_path / "text").write_bytes(text)
    base = ["run", "--model", model_file, "--tokens", str(tmp_path / "ids")]
    assert main([*base, "--logits-out", str(tmp_path / "logits"), "--dump-taps", str(tmp_path / "taps")]) == 0
    lines = capsys.readouterr().out.splitlines()
    want = forward.forward(C, W, ids)
    assert len(lines) == 32 and lines[3].split()[2] == LABELS[int(want[3].argmax())]
    assert np.allclose(np.frombuffer((tmp_path / "logits").read_bytes(), "<f4").reshape(want.shape), want, atol=1e-5)
    assert files.read_taps(spark, str(tmp_path / "taps")).filter("tap = 'logits'").count() == len(ids)
    assert main([*base, "--offsets", str(tmp_path / "offsets"), "--text", str(tmp_path / "text"), "--window", "64"]) == 0
    got = json.loads(capsys.readouterr().out)
    docs = spark.createDataFrame([(1, text.decode())], "doc_id int, text string")
    assert got and all(g["text"] == g["text"].strip() and text[g["start"] : g["end"]].decode() == g["text"] for g in got)
    whole = Engine.from_gguf(model_file, threshold=0.0).classify(docs).first().entities
    assert {(e.start, e.end) for e in whole if e.label == "secret"} <= {(g["start"], g["end"]) for g in got} or not whole
    assert main(base[:3]) == 2 and main([*base, "--nope", "1"]) == 2 and main(["run", "--model", model_file, "--tokens", str(tmp_path / "none")]) == 1


def test_speed_and_requantised(model_file, tmp_path):
    from spanloom.plans.speed import throughput

    rows = throughput(Engine.from_gguf(model_file, window=64), (32, 200), 1)
    assert [r["tokens"] for r in rows] == [32, 200] and all(r["tokens_a_second"] > 0 for r in rows)
    wide = dataclasses.replace(C, width=32)
    w = forward.random_weights(wide, 256, seed=2)
    gguf.write_gguf(str(tmp_path / "w"), gguf.metadata_of(wide, LABELS, "toy"), w)
    chosen = gguf.requantised(str(tmp_path / "w"), str(tmp_path / "q"), r"exps|embd|norm")
    again = gguf.ModelFile(str(tmp_path / "q"))
    assert "token_embd.weight" in chosen and not any("norm" in k or "bias" in k and w[k].ndim == 1 for k in chosen)
    assert all(np.abs(again.tensor(k) - w[k]).max() <= (0.05 if k in chosen else 0) for k in w)


def test_extended_head():
    from spanloom.functions import labels as L

    labels = ["O", *(f"{t}-secret" for t in "BIES")]
    weight, bias = np.arange(15.0, dtype=np.float32).reshape(5, 3), np.ones(5, np.float32)
    w, b, names = L.extend_head(weight, bias, labels)
    assert names == L.extend_labels(labels) and w.shape == (len(names), 3) and len(b) == len(names) > 5
    assert np.array_equal(w[:5], weight) and np.array_equal(b[:5], bias) and not b[5:].any() and 0 < np.abs(w[5:]).max() < 0.2 and w.dtype == np.float32
    assert np.array_equal(L.extend_head(w, b, names)[0], w)


def test_taps_differ_as_sets(spark):
    rows = lambda order, third: [("embd", 0, [1.0, 2.0]), ("l0.moe_logits", 0, [3.0, 2.0, 1.0]), ("l0.moe_topk", 0, order), ("l0.moe_logits", 1, [3.0, 1.0001, 1.0]), ("l0.moe_topk", 1, third), ("l1.attn_out", 0, [1.0])]
    frame = lambda r: spark.createDataFrame(r, "tap string, row int, val array<double>")
    ref = frame(rows([0.0, 1.0], [0.0, 1.0]))
    same = {r.tap: (r.rows, r.max_diff, r.differing_sets, r.ties) for r in evaluate.tap_differences(ref, frame(rows([1.0, 0.0], [0.0, 2.0]))).collect()}
    assert same["l0.moe_topk"] == (2, 0.0, 0, 1) and same["embd"] == (1, 0.0, 0, 0)
    other = frame([(t, r, [x + (t == "l1.attn_out") for x in v]) for t, r, v in rows([0.0, 2.0], [0.0, 1.0])])
    assert tuple(evaluate.first_divergence(ref, other).first())[0] == "l0.moe_topk"
    later = frame([(t, r, [x + (t == "l1.attn_out") for x in v]) for t, r, v in rows([1.0, 0.0], [0.0, 2.0])])
    assert tuple(evaluate.first_divergence(ref, later).first()) == ("l1.attn_out", 104, 1.0)
    assert evaluate.first_divergence(ref, ref).collect() == []


def test_session_options():
    from spanloom.plans.engine import session_options

    assert session_options() == {} and session_options("cpu", 4)["spark.task.cpus"] == "4" and "spark.task.resource.gpu.amount" in session_options("cuda:1")
    with pytest.raises(ValueError):
        session_options("abacus")


def test_letters():
    text = synthetic.letters()
    assert text == synthetic.letters() and len(text.split("\n\n")) == 90 and text.count("@post") == 90


def test_bad_model_files_raise(tmp_path):
    bad = {"none": None, "short": b"GGUF\x03", "not": b"nothing at all, but long enough to look at"}
    for name, raw in bad.items():
        if raw is not None:
            (tmp_path / name).write_bytes(raw)
        with pytest.raises(gguf.ModelFileError):
            gguf.ModelFile(str(tmp_path / name))
    whole = gguf.metadata_of(C, LABELS, "toy")
    cases = {"labels": whole | {"toy.classifier.output_labels": LABELS[:3]}, "key": {k: v for k, v in whole.items() if "head_count_kv" not in k}}
    for name, meta in cases.items():
        gguf.write_gguf(str(tmp_path / name), meta, {})
        with pytest.raises(gguf.ModelFileError):
            gguf.ModelFile(str(tmp_path / name))
    gguf.write_gguf(str(tmp_path / "empty"), whole, {})
    with pytest.raises(gguf.ModelFileError, match="missing tensors"):
        gguf.ModelFile(str(tmp_path / "empty")).weights()
    with pytest.raises(gguf.ModelFileError, match="architecture"):
        gguf.ModelFile(str(tmp_path / "empty"), arch="other")


def test_span_jsonl(spark, tmp_path):
    for name in ("a", "b"):
        lines = [json.dumps({"text": f"{name}{k}", "spans": [{"start": 0, "end": 1, "label": "x"}]}) for k in range(4)]
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n")
    got = files.read_spans(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], skip=1).orderBy("text").collect()
    assert [(r.text, r.row_no) for r in got] == [(f"{n}{k}", k - 1) for n in "ab" for k in (1, 2, 3)] and got[0].spans[0].label == "x"


def test_texts_and_label_space(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("a\nb\n\n")
    assert files.read_texts(spark, str(tmp_path / "t")).first().text == "a\nb\n"
    (tmp_path / "l.json").write_text(json.dumps({"name": "n", "labels": [{"name": "secret", "redaction": "[S]", "description": "d"}]}))
    assert tuple(files.read_label_space(spark, str(tmp_path / "l.json")).first()) == ("secret", "[S]", "d")


def test_packs(spark, tmp_path):
    texts = [b"", b"ab\x80", "é".encode()]
    (tmp_path / "p.bin").write_bytes(files.pack_texts(texts))
    assert [bytes(r.raw) for r in files.read_packs(spark, str(tmp_path / "p.bin")).orderBy("pos").collect()] == texts
    rows = [[(1, 0, 2), (5, 2, 3)], []]
    assert files.parse_tokens(files.pack_tokens(rows)) == rows
    (tmp_path / "i").write_bytes(np.arange(3, dtype="<i4").tobytes())
    assert files.read_i32(str(tmp_path / "i")).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        files.parse_pack(files.pack_texts(texts)[:-1])


def test_taps_diverge(spark, tmp_path):
    taps = {}
    forward.forward(C, W, np.arange(6), taps)
    files.write_taps(str(tmp_path / "a"), taps, 6)
    taps["l1.attn_out"] = taps["l1.attn_out"] + 1
    files.write_taps(str(tmp_path / "b"), taps, 6)
    a, b = (files.read_taps(spark, str(tmp_path / x)) for x in "ab")
    assert evaluate.first_divergence(a, b, list(taps)).first().tap == "l1.attn_out" and evaluate.first_divergence(a, a, list(taps)).count() == 0


def test_safetensors_and_tokenizer(tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "h": {"dtype": "BF16", "shape": [1], "data_offsets": [24, 26]}}).encode()
    (tmp_path / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + x.tobytes() + b"\x80\x3f")
    got = dict(files.read_safetensors(str(tmp_path)))
    assert np.array_equal(got["w"], x) and got["h"].tolist() == [1.0]
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 2}, "merges": [["a", "b"]]}, "added_tokens": [{"id": 4, "content": "<e>", "special": True}]}))
    (tmp_path / "config.json").write_text(json.dumps({"eos_token_id": 4, "vocab_size": 6}))
    t = files.read_hf_tokenizer(str(tmp_path))
    assert t["tokens"] == ["a", "[PAD1]", "b", "[PAD3]", "<e>", "[PAD5]"] and t["merges"] == ["a b"] and t["eos"] == 4


def test_parity_and_minimiser(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 1.0005], [1.0005, 1.0]), ([0.0, 5.0], [5.0, 0.0])], "ref array<double>, got array<double>")
    got = evaluate.row_parity(df).collect()
    assert [(r.same_argmax, r.tie) for r in got] == [(True, False), (False, True), (False, False)] and got[0].cosine == pytest.approx(1) and got[2].row_err == 1
    assert evaluate.minimised("aaaaXbbbbY", lambda t: "X" in t and "Y" in t) == "XY"


def test_sinks(spark, tmp_path):
    docs = synthetic.pii_documents(spark, 5, 2)
    e = Engine().redact(docs)
    assert e.filter("size(entities) >= 6").count() == 5
    found = json.loads(e.select(sinks.entities_json("text", "entities")).first()[0])
    assert found[0]["text"].startswith("clerk") and found[0]["score"] == 1.0
    sinks.write_redacted(e, str(tmp_path / "r"))
    sinks.write_predictions(e.withColumn("spans", e.entities), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 5 and spark.read.text(str(tmp_path / "r")).count() >= 5
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (5, 6)], "cp int, mask int")
    assert sorted(tuple(r) for r in sinks.coalesced_ranges(points).collect()) == [(1, 2, 5), (3, 3, 6), (5, 5, 6)]
    assert sinks.trace(e.withColumn("n_tokens", e.doc_id), spans_col="entities").columns == ["document", "n_tokens", "entities"]


def test_quantisation():
    x = np.random.default_rng(0).normal(size=640).astype(np.float32)
    assert np.abs(forward.dequantise_q8(*forward.quantise_q8(x)) - x).max() < 0.02


def test_entities_of_the_worker_are_those_of_columns(spark):
    import random

    from spanloom.operators import post

    r = random.Random(4)
    letters = "ab =\t　,、é日（x"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 25))) for _ in range(60)]
    rows, spans = [], []
    for i, t in enumerate(texts):
        edges = [len(t[:k].encode()) for k in range(len(t) + 1)]
        own = [(r.choice([-1, *edges]), r.choice([*edges, edges[-1] + 1]), 1.0, r.choice(["private_person", "secret"])) for _ in range(5)]
        rows.append((i, t, own))
        spans += [(i, *x) for x in own]
    df = spark.createDataFrame(rows, "i int, text string, s array<struct<start:int,end:int,score:float,label:string>>")
    want = [(x.i, x.e.start, x.e.end, x.e.label) for x in df.select("i", F.explode(post.clean("text", "s")).alias("e")).collect()]
    row, start, end = (np.array([x[k] for x in spans]) for k in range(3))
    which, a, b = post.clean_bytes([t.encode() for t in texts], row, start, end, np.array([x[4] == "private_person" for x in spans]))
    assert sorted(want) == sorted(zip(row[which].tolist(), a.tolist(), b.tolist(), [spans[k][4] for k in which.tolist()]))


def test_a_long_text_is_classified_in_linear_time(spark):
    """Each span copied the whole text before: some 25,000 spans, 0.2 MB each."""
    import time

    from spanloom.plans.queries import _tiny

    docs = spark.createDataFrame([(1, "anb lew sttible = " * 12_000), (2, None), (None, "ab"), (None, "ab")], "doc_id long, text string")
    began = time.time()
    got = _tiny().entity_rows(docs).collect()
    assert len(got) > 10_000 and time.time() - began < 40
    arrays = _tiny().classify(docs)
    assert arrays.filter("doc_id = 2").first().entities is None
    assert sorted(map(str, map(tuple, got))) == sorted(str((x.doc_id, x.e.start, x.e.end, x.e.label, x.e.score)) for x in arrays.select("doc_id", F.explode("entities").alias("e")).collect())
