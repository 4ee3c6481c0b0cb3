"""python -m spanloom redact|classify|info [MODEL] [options] < text
python -m spanloom tok-batch MODEL TEXT_PACK TOKEN_PACK
python -m spanloom speed MODEL [LENGTH ...]
python -m spanloom run --model MODEL --tokens I32 [--window N] [--threads N] [--device D] [--dump-taps DIR]
    [--logits-out FILE] [--offsets I32 --text FILE [--threshold F]]

Without a model file the rules detect.  ``run`` reads token ids: it prints the
spans where offsets and a text are given, else the first tokens' labels.
Exit codes: 2 for usage, 1 for failure.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from spanloom.operators import bpe, decode, forward
from spanloom.plans.engine import Engine, cli_options, device, session_options
from spanloom.sources import files
from spanloom.sources.gguf import ModelFileError
from spanloom.sources.sinks import entities_json


def tok_batch(model: str, texts: str, out: str) -> None:
    """Tokens of every text of a pack, as a token pack."""
    engine = Engine.from_gguf(model)
    with open(out, "wb") as f:
        for raw in files.parse_pack(Path(texts).read_bytes()):
            f.write(files.pack_tokens([bpe.encode_bytes(engine.vocabulary, raw)]))


RUN_OPTIONS = {"--model": str, "--tokens": str, "--dump-taps": str, "--logits-out": str, "--offsets": str, "--text": str, "--device": str, "--threads": int, "--window": int, "--threshold": float}


def run_tokens(args: list[str]) -> list[str]:
    """What ``run`` prints: spans as JSON, or a line for each of the first 32 tokens."""
    if len(args) % 2 or any(a not in RUN_OPTIONS for a in args[::2]):
        raise ValueError(f"unknown or unfinished option in {' '.join(args)}")
    o = {a: RUN_OPTIONS[a](v) for a, v in zip(args[::2], args[1::2])}
    if "--model" not in o or "--tokens" not in o:
        raise ValueError("run needs --model and --tokens")
    device(o.get("--device", "cpu"))
    engine = Engine.from_gguf(o["--model"], window=o.get("--window", 4096), threshold=o.get("--threshold", 0.0))
    ids, weights = files.read_i32(o["--tokens"]).astype(np.int64), engine.load()
    taps: dict | None = {} if "--dump-taps" in o else None
    if taps is not None:
        forward.forward(engine.config, weights, ids, taps)
        files.write_taps(o["--dump-taps"], taps, len(ids))
    logits = forward.logits_of_texts(engine.config, weights, [ids], engine.window)[0]
    if "--logits-out" in o:
        Path(o["--logits-out"]).write_bytes(logits.astype("<f4").tobytes())
    if "--offsets" in o and "--text" in o:
        offsets, raw = files.read_i32(o["--offsets"]).reshape(-1, 2), Path(o["--text"]).read_bytes()
        logp, out = forward.log_softmax(logits), []
        for cat, first, last, score in decode.assemble(engine.table, decode.viterbi(engine.table, logp), logp):
            start, end = int(offsets[first, 0]), int(offsets[last, 1])
            if score < np.float32(engine.threshold) or not 0 <= start < end <= len(raw):
                continue
            while start < end and raw[start] <= 0x20:
                start += 1
            while start < end and raw[end - 1] <= 0x20:
                end -= 1
            if start < end:
                out.append({"entity_group": engine.table.categories[cat], "start": start, "end": end, "score": round(score, 4), "text": raw[start:end].decode("utf-8", "replace")})
        return [json.dumps(out, ensure_ascii=False)]
    return [f"{t:3d} {ids[t]:<6d} {engine.labels[int(logits[t].argmax())]}" for t in range(min(32, len(ids)))]


def main(args: list[str], stdin=None) -> int:
    if args and args[0] in ("tok-batch", "run", "speed"):
        try:
            if args[0] == "tok-batch":
                tok_batch(*args[1:])
            elif args[0] == "run":
                print("\n".join(run_tokens(args[1:])))
            else:
                from spanloom.plans.speed import throughput

                for row in throughput(Engine.from_gguf(args[1]), tuple(map(int, args[2:])) or (128, 512, 2048, 8192)):
                    print(json.dumps(row))
            return 0
        except (ModelFileError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
        except (ValueError, TypeError, IndexError) as e:
            print(f"{e}\n{__doc__}", file=sys.stderr)
            return 2
    if not args or args[0] not in ("redact", "classify", "info"):
        print(__doc__, file=sys.stderr)
        return 2
    mode, rest = args[0], args[1:]
    model = rest.pop(0) if rest and rest[0].endswith(".gguf") else None
    try:
        options = cli_options(rest)
        device(options["device"])
    except ValueError as e:
        print(f"{e}\n{__doc__}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("spanloom").config("spark.ui.enabled", "false").config(map=session_options(options["device"])).getOrCreate()
    try:
        engine = Engine.from_gguf(model, threshold=options["threshold"]) if model else Engine(threshold=options["threshold"])
    except ModelFileError as e:
        print(e, file=sys.stderr)
        return 1
    if mode == "info":
        for r in engine.info(spark).collect():
            print(f"{r.key}: {r.value}")
        return 0
    text = (stdin or sys.stdin).read()
    docs = spark.createDataFrame([(0, text.removesuffix("\n"))], "doc_id int, text string")
    if mode == "redact":
        print(engine.redact(docs, labels=options["labels"], replacement=options["replacement"]).first().redacted)
    else:
        print(engine.classify(docs).select(entities_json("text", "entities")).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
