"""How fast an engine runs, by length of text and by stage."""

from __future__ import annotations

import time

import numpy as np

from spanloom.operators import bpe, decode, forward
from spanloom.plans.engine import Engine
from spanloom.sources.synthetic import letters


def throughput(engine: Engine, lengths: tuple[int, ...] = (128, 512, 2048, 8192), iterations: int = 3, exact: bool = True) -> list[dict]:
    """For texts of about so many tokens: tokens, milliseconds a stage, and tokens a second of the forward pass.

    In one process, without Spark, after a round that isn't timed.  ``exact``
    cuts the tokens to the length asked.
    """
    weights, out = engine.load(), []
    text = letters(400).encode()
    for target in lengths:
        sample = text * (1 + 8 * target // len(text))
        spent = np.zeros(3)
        for k in range(iterations + 1):
            at = [time.perf_counter()]
            ids = bpe.encode_texts(engine.vocabulary, [sample[: 8 * target]])[0][:, 0].astype(np.int64)
            ids = ids[:target] if exact else ids
            at.append(time.perf_counter())
            logp = forward.log_softmax(forward.logits_of_texts(engine.config, weights, [ids], engine.window)[0])
            at.append(time.perf_counter())
            decode.assemble(engine.table, decode.viterbi(engine.table, logp), logp)
            at.append(time.perf_counter())
            spent += np.diff(at) if k else 0
        tok, fwd, dec = (1000 * spent / iterations).tolist()
        out.append({"tokens": len(ids), "tokenise_ms": round(tok, 3), "forward_ms": round(fwd, 3), "decode_ms": round(dec, 3), "tokens_a_second": round(len(ids) / max(fwd / 1000, 1e-9))})
    return out
