"""Forward pass of a sliding-window mixture-of-experts token classifier, in numpy.

Windows of documents are independent rows, so a batch of them is a task's
work; weights are opened once a worker.  No weights come with this package:
it runs those it is given, or small ones made from a seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From so many tokens on, attention is worked out in blocks.
BANDED_FROM = 2048
MOE_CHUNK = 4096
#: Tokens of texts that are held at once, where one text isn't longer.
BATCH_TOKENS = 1 << 17
#: Tokens of windows of one length that are worked out at once.
STEP_TOKENS = 8192
ALPHA, LIMIT = 1.702, 7.0


@dataclass(frozen=True)
class Config:
    """Sizes and constants of a model."""

    layers: int
    width: int
    heads: int
    kv_heads: int
    head_dim: int
    expert_width: int
    experts: int
    experts_used: int
    radius: int
    context: int
    context_original: int
    classes: int
    eps: float = 1e-5
    rope_base: float = 150000.0
    yarn_factor: float = 1.0
    beta_fast: float = 32.0
    beta_slow: float = 1.0
    truncate: bool = False

    @property
    def halo(self) -> int:
        return self.layers * self.radius

    def as_row(self) -> dict:
        return asdict(self)


def tensor_shapes(c: Config, vocab: int) -> dict[str, tuple[int, ...]]:
    """Name and shape of every tensor: four of the model and nineteen a layer."""
    out = {"token_embd.weight": (vocab, c.width), "output_norm.weight": (c.width,), "cls.output.weight": (c.classes, c.width), "cls.output.bias": (c.classes,)}
    q, kv = c.heads * c.head_dim, c.kv_heads * c.head_dim
    for i in range(c.layers):
        own = {
            "attn_norm.weight": (c.width,), "post_attention_norm.weight": (c.width,), "attn_sinks.weight": (c.heads,),
            "ffn_gate_inp.weight": (c.experts, c.width), "ffn_gate_inp.bias": (c.experts,),
        }
        for name, rows, cols in (("attn_q", q, c.width), ("attn_k", kv, c.width), ("attn_v", kv, c.width), ("attn_output", c.width, q)):
            own |= {f"{name}.weight": (rows, cols), f"{name}.bias": (rows,)}
        for name, rows, cols in (("ffn_gate_exps", c.expert_width, c.width), ("ffn_up_exps", c.expert_width, c.width), ("ffn_down_exps", c.width, c.expert_width)):
            own |= {f"{name}.weight": (c.experts, rows, cols), f"{name}.bias": (c.experts, rows)}
        out |= {f"blk.{i}.{k}": v for k, v in own.items()}
    return out


def random_weights(c: Config, vocab: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Small weights from a seed, for tests of structure."""
    rng = np.random.default_rng(seed)
    return {k: (1 + 0.1 * rng.normal(size=s) if "norm" in k else rng.normal(size=s) / math.sqrt(s[-1])).astype(np.float32) for k, s in tensor_shapes(c, vocab).items()}


def missing_tensors(c: Config, weights: dict[str, np.ndarray]) -> list[str]:
    return [k for k in tensor_shapes(c, 0) if k not in weights]


def yarn(c: Config) -> tuple[np.ndarray, float]:
    """(inverse frequencies, attention scale): long waves are stretched, short ones kept, a ramp between."""
    half = np.arange(c.head_dim // 2)
    own = c.rope_base ** (-2.0 * half / c.head_dim)
    if c.yarn_factor <= 1:
        return own, 1.0
    at = lambda turns: c.head_dim * math.log(c.context_original / (turns * 2 * math.pi)) / (2 * math.log(c.rope_base))
    low, high = at(c.beta_fast), at(c.beta_slow)
    if c.truncate:
        low, high = math.floor(low), math.ceil(high)
    low, high = max(low, 0.0), min(high, c.head_dim - 1.0)
    ramp = np.clip((half - low) / max(high - low, 1e-3), 0, 1)
    return own * (1 - ramp) + own / c.yarn_factor * ramp, 0.1 * math.log(c.yarn_factor) + 1


def rope(x: np.ndarray, frequencies: np.ndarray, scale: float) -> np.ndarray:
    """(..., tokens, heads, dim) with each pair (2i, 2i+1) turned by its token's angle."""
    angle = np.arange(x.shape[-3])[:, None] * frequencies
    cos, sin = ((f(angle) * scale).astype(np.float32)[:, None, :] for f in (np.cos, np.sin))
    out = np.empty_like(x)
    out[..., 0::2] = x[..., 0::2] * cos - x[..., 1::2] * sin
    out[..., 1::2] = x[..., 0::2] * sin + x[..., 1::2] * cos
    return out


def band_mask(n: int, radius: int) -> np.ndarray:
    """Which token sees which."""
    at = np.arange(n)
    return np.abs(at[:, None] - at[None, :]) <= radius


def _softmax_sink(score: np.ndarray, sink: np.ndarray) -> np.ndarray:
    """Softmax over the last axis, the sink's share going nowhere; ``score`` is used up."""
    top = np.maximum(score.max(axis=-1, keepdims=True), sink)
    score -= top
    e = np.exp(score, out=score)
    e /= e.sum(axis=-1, keepdims=True) + np.exp(sink - top)
    return e


#: Scores of attention that are worked out together, so that they stay in a core's cache.
SCORES = 1 << 16


def _attend(q, k, v, sinks, seen: np.ndarray) -> np.ndarray:
    """(..., queries, heads, dim): each query over the keys that it sees, key heads shared by groups of query heads."""
    share = q.shape[-2] // k.shape[-2]
    q, k, v = (np.swapaxes(x, -3, -2) for x in (q, np.repeat(k, share, axis=-2), np.repeat(v, share, axis=-2)))
    hidden, sink, scale = ~seen, sinks[:, None, None], math.sqrt(q.shape[-1])

    def of(q, k, v):
        score = q @ np.swapaxes(k, -1, -2)
        score /= scale
        np.copyto(score, -np.inf, where=hidden)
        return _softmax_sink(score, sink) @ v

    if q.ndim == 4:  # windows don't depend on each other
        step = max(1, SCORES // max(1, q.shape[1] * seen.size))
        out = np.concatenate([of(q[a : a + step], k[a : a + step], v[a : a + step]) for a in range(0, len(q), step)])
    else:
        out = of(q, k, v)
    return np.swapaxes(out, -3, -2).astype(np.float32)


def attention_full(q, k, v, sinks, radius: int) -> np.ndarray:
    """(..., tokens, heads, dim) over the whole matrix of scores."""
    return _attend(q, k, v, sinks, band_mask(q.shape[-3], radius))


def attention_banded(q, k, v, sinks, radius: int, block: int | None = None) -> np.ndarray:
    """The same, in blocks of queries that see their own and the two next blocks of keys: memory grows with n, not n squared."""
    n, b = q.shape[-3], max(block or 2 * radius, radius, 1)
    out = np.empty_like(q)
    for s in range(0, n, b):
        e, lo, hi = min(n, s + b), max(0, s - b), min(n, s + 2 * b)
        near = np.abs(np.arange(s, e)[:, None] - np.arange(lo, hi)[None, :]) <= radius
        out[..., s:e, :, :] = _attend(q[..., s:e, :, :], k[..., lo:hi, :, :], v[..., lo:hi, :, :], sinks, near)
    return out


def swiglu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    """(clamp(up) + 1) * g * sigmoid(1.702 g), g the gate cut above."""
    g = np.minimum(gate, LIMIT)
    return (np.clip(up, -LIMIT, LIMIT) + 1) * g / (1 + np.exp(-ALPHA * g))


def top_experts(logits: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """(experts, weights) of each token: the best, ties to the least, with a softmax over those alone."""
    best = np.argsort(-logits, axis=1, kind="stable")[:, :used]
    x = np.take_along_axis(logits, best, axis=1)
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return best, e / e.sum(axis=1, keepdims=True)


def experts(x: np.ndarray, w: Callable[[str], np.ndarray], used: int, taps: dict | None = None) -> np.ndarray:
    """The mixture's output; tokens are gathered by expert."""
    logits = x @ w("ffn_gate_inp.weight").T + w("ffn_gate_inp.bias")
    best, weight = top_experts(logits, used)
    if taps is not None:
        taps |= {"moe_logits": logits, "moe_topk": best.astype(np.int32), "moe_weights": weight}
    out = np.zeros_like(x)
    part = lambda name, e, y: y @ w(f"{name}.weight")[e].T + w(f"{name}.bias")[e]
    for e in np.unique(best):
        token, slot = np.nonzero(best == e)
        y = x[token]
        y = part("ffn_down_exps", e, swiglu(part("ffn_gate_exps", e, y), part("ffn_up_exps", e, y)).astype(np.float32))
        out[token] += weight[token, slot][:, None].astype(np.float32) * y
    return out


def forward(c: Config, weights: dict[str, np.ndarray], ids: np.ndarray, taps: dict[str, np.ndarray] | None = None, banded: bool | None = None, moe_chunk: int = MOE_CHUNK, without: str = "") -> np.ndarray:
    """(tokens, classes) logits, or (windows, tokens, classes) of ids in two dimensions.

    What concerns single tokens is one product over all windows.  ``taps``
    gathers what each step makes, ``without`` leaves out 'noattn' or 'nomoe'.
    """
    ids = np.asarray(ids)
    shape, n = ids.shape, ids.size
    if n == 0:
        return np.zeros((*shape, c.classes), np.float32)
    frequencies, scale = yarn(c)
    banded = shape[-1] >= BANDED_FROM if banded is None else banded
    see = lambda name, x: taps.__setitem__(name, x) if taps is not None else None
    norm = lambda x, w: (x / np.sqrt((x * x).mean(axis=1, keepdims=True) + c.eps) * w).astype(np.float32)
    x = weights["token_embd.weight"][ids.ravel()].astype(np.float32)
    see("embd", x)
    for i in range(c.layers):
        w = lambda name, i=i: weights[f"blk.{i}.{name}"]
        h = norm(x, w("attn_norm.weight"))
        see(f"l{i}.attn_norm", h)
        if "noattn" not in without:
            q, k, v = ((h @ w(f"attn_{z}.weight").T + w(f"attn_{z}.bias")).reshape(*shape, m, c.head_dim) for z, m in (("q", c.heads), ("k", c.kv_heads), ("v", c.kv_heads)))
            q, k = rope(q, frequencies, scale), rope(k, frequencies, scale)
            see(f"l{i}.q_rope", q)
            see(f"l{i}.k_rope", k)
            a = (attention_banded if banded else attention_full)(q, k, v, w("attn_sinks.weight"), c.radius).reshape(n, c.heads * c.head_dim)
            h = a @ w("attn_output.weight").T + w("attn_output.bias")
            see(f"l{i}.attn_out", h)
        x = x + h
        see(f"l{i}.ffn_inp", x)
        h = norm(x, w("post_attention_norm.weight"))
        see(f"l{i}.post_norm", h)
        if "nomoe" not in without:
            step = moe_chunk or n
            mine: dict | None = {} if taps is not None and n <= step else None
            h = np.concatenate([experts(h[a : a + step], w, c.experts_used, mine) for a in range(0, n, max(step, 1))]) if n else h
            for name, value in (mine or {}).items():
                see(f"l{i}.{name}", value)
            see(f"l{i}.moe_out", h)
        x = x + h
        see(f"l{i}.l_out", x)
    x = norm(x, weights["output_norm.weight"])
    see("result_norm", x)
    logits = (x @ weights["cls.output.weight"].T + weights["cls.output.bias"]).astype(np.float32)
    see("logits", logits)
    return logits.reshape(*shape, c.classes)


def cut_windows(n: int, window: int, halo: int) -> list[tuple[int, int, int, int]]:
    """(start, wlen, lo, hi) of the windows of n tokens, as ``operators.windows`` cuts them."""
    if n <= window:
        return [(0, n, 0, n)]
    if window <= 2 * halo:
        raise ValueError(f"{n} tokens need a window of more than {2 * halo}")
    stride = window - 2 * halo
    out = []
    for start in range(0, n, stride):
        wlen = min(window, n - start)
        end = start + wlen >= n
        out.append((start, wlen, halo if start else 0, wlen if end else wlen - halo))
        if end:
            break
    return out


def logits_of_texts(c: Config, weights: dict[str, np.ndarray], texts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """(tokens, classes) of each array of ids, windows of one length worked out together, STEP_TOKENS at once."""
    out = [np.zeros((len(x), c.classes), np.float32) for x in texts]
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, x in enumerate(texts):
        for start, wlen, lo, hi in cut_windows(len(x), window, c.halo) if len(x) else []:
            by_length.setdefault(wlen, []).append((i, start, lo, hi))
    for wlen, found in sorted(by_length.items()):
        step = max(1, STEP_TOKENS // wlen)
        for a in range(0, len(found), step):
            some = found[a : a + step]
            made = forward(c, weights, np.stack([texts[i][s : s + wlen] for i, s, _, _ in some]))
            for (i, s, lo, hi), rows in zip(some, made):
                out[i][s + lo : s + hi] = rows[lo:hi]
    return out


def log_softmax(x: np.ndarray) -> np.ndarray:
    """Log-probabilities of rows of logits, summed in double."""
    x = x.astype(np.float64)
    x = x - x.max(axis=-1, keepdims=True)
    return (x - np.log(np.exp(x).sum(axis=-1, keepdims=True))).astype(np.float32)


def logits_of_windows(windowed: DataFrame, config: Config, load: Callable[[], dict[str, np.ndarray]], ids_col: str = "win_ids", out_col: str = "rows") -> DataFrame:
    """``windowed`` with (tokens, classes) logits for its ids.

    ``load`` gives the weights and is called once a worker: from a file that
    every executor has (or was sent), which it may map instead of reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = load()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [np.asarray(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], np.int64) for x in column]
            made = logits_of_texts(config, weights, texts, max([1, *map(len, texts)]))
            rows = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            flat = np.concatenate(made) if made else np.zeros((0, config.classes), np.float32)
            inner = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, config.classes, dtype=np.int32), flat.ravel())
            yield batch.append_column(out_col, pa.ListArray.from_arrays(rows, inner))

    from pyspark.sql import types as T

    schema = T.StructType([*windowed.schema.fields, T.StructField(out_col, T.ArrayType(T.ArrayType(T.FloatType())))])
    return windowed.mapInArrow(run, schema)


def emissions(tokens: DataFrame, config: Config, load: Callable[[], dict[str, np.ndarray]], ids_col: str = "ids", window: int = 4096) -> DataFrame:
    """Columns of ``tokens`` but the ids, tok_pos, logits and logp: a row for each token, windows stitched."""
    from spanloom.operators.windows import explode_windows, log_softmax, stitch

    done = logits_of_windows(explode_windows(tokens, ids_col, window, config.halo), config, load)
    return stitch(done, out_col="logits").withColumn("logp", log_softmax("logits").cast("array<float>"))


def with_emissions(docs: DataFrame, config: Config, load: Callable[[], dict[str, np.ndarray]], of: Callable[[list[np.ndarray]], pa.Array], out_col: str, out_type: str, tokens_col: str = "tokens", window: int = 4096) -> DataFrame:
    """``docs`` with a column that ``of`` makes of the log-probabilities of each row's tokens; nothing is shuffled, and no row needs an id.

    Null tokens give no rows of log-probabilities.  Texts are taken together
    up to BATCH_TOKENS; a longer one is worked out window by window, and its
    log-probabilities (four bytes a token and class) are held at once.
    """
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = load()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(tokens_col))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_TOKENS, side="right")) - 1)
                part = batch.slice(a, b - a)
                ids = part.column(batch.schema.get_field_index(tokens_col)).flatten().field("id").to_numpy(zero_copy_only=False).astype(np.int64)
                texts = np.split(ids, (ends[a + 1 : b] - ends[a]))
                yield part.append_column(out_col, of([log_softmax(x) for x in logits_of_texts(config, weights, texts, window)]))
                a = b

    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T._parse_datatype_string(out_type))])
    return docs.mapInArrow(run, schema)


def tap_rows(taps: dict[str, np.ndarray]) -> Iterator[tuple[str, int, list[float]]]:
    """(tap, row, values) of captured steps."""
    for name, x in taps.items():
        for k, row in enumerate(np.asarray(x, np.float64).reshape(len(x), -1)):
            yield name, k, row.tolist()


def quantise_q8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scales, int8 values) in blocks of 32."""
    b = x.reshape(-1, 32).astype(np.float32)
    scale = (np.abs(b).max(axis=1) / 127).astype(np.float16)
    s = scale.astype(np.float32)[:, None]
    return scale, np.rint(np.divide(b, s, out=np.zeros_like(b), where=s > 0)).astype(np.int8)


def dequantise_q8(scale: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (scale.astype(np.float32)[:, None] * values.astype(np.float32)).ravel()
