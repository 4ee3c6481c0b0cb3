"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads to resampled 16-bit PCM.

Mu-law and A-law bytes are expanded through tables of 256 values.  ADPCM is
decoded one sample at a time, but for all blocks of a batch at once.  The
signals of a batch are laid end to end with silence between them, so that one
polyphase filter resamples them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B

CODECS = ("mulaw", "alaw", "adpcm")
RATE_IN, RATE_OUT = 8000, 16000
#: Bytes of an ADPCM block: a first sample, a step index, an unused byte, then two samples a byte.
BLOCK = 256
#: Taps of a filter phase.
TAPS = 16
CHUNK = 512 << 10

_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    x = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -x, x).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exp, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    x = np.where(exp == 0, low + 8, low + 0x108 << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, x, -x).astype(np.int16)


@lru_cache(maxsize=1)
def step_table() -> np.ndarray:
    """The 89 step sizes of the public IMA specification: each about a tenth over the last."""
    steps = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(steps, np.int64)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) of whole blocks of bytes, every block at once."""
    steps = step_table()
    value = (blocks[:, 0].astype(np.int64) | blocks[:, 1].astype(np.int64) << 8)
    value = np.where(value >= 1 << 15, value - (1 << 16), value)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * data.shape[0], len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * data.shape[0]):
        code = (data[k >> 1] >> (4 * (k & 1))) & 0x0F
        step = steps[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + _INDEX[code], 0, 88)
        out[1 + k] = value
    return out.T


def adpcm_lengths(size: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples in payloads of so many bytes; a last block of under 4 bytes has none."""
    rest = size % block
    return size // block * (1 + 2 * (block - 4)) + np.where(rest >= 4, 1 + 2 * (rest - 4), 0)


def decode_adpcm(raw: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(samples, samples in each) of payloads that lie in ``raw``; a short last block ends early."""
    many = -(-size // block)
    doc = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = start[doc] + k * block
    room = np.minimum(size[doc] - k * block, block)
    buf = np.concatenate([raw, np.zeros(block, np.uint8)])
    whole = adpcm_blocks(buf[at[:, None] + np.arange(block)]) if len(at) else np.zeros((0, 1 + 2 * (block - 4)), np.int16)
    n = np.where(room >= 4, 1 + 2 * (room - 4), 0)
    return whole[np.arange(whole.shape[1]) < n[:, None]], adpcm_lengths(size, block)


@lru_cache(maxsize=8)
def filter_phases(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """(up, taps) windowed-sinc coefficients; each phase sums to 1."""
    t = np.arange(taps)[None, :] - taps // 2 + 1 - np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * t) * np.cos(np.pi * np.clip(t / taps, -0.5, 0.5)) ** 2
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, lengths: np.ndarray, rate_in: int, rate_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Signals laid end to end, each brought to another rate; silence is assumed beyond its ends."""
    g = math.gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    if up == down:
        return samples, lengths
    h = filter_phases(up, down)
    taps = h.shape[1]
    slot = -(-(lengths + taps) // down) * down
    first = np.cumsum(slot) - slot
    lead = taps // 2 - 1
    x = np.zeros(int(slot.sum()) + 2 * taps, np.float32)
    place = np.arange(len(samples)) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    x[lead + place] = samples
    frames = int(slot.sum()) // down
    y = np.empty((frames, up), np.float32)
    for i in range(up):
        phase, skip = i * down % up, i * down // up
        acc = np.zeros(frames, np.float32)
        for k in np.flatnonzero(np.abs(h[phase]) > 1e-9):
            acc += h[phase, k] * x[skip + k :: down][:frames]
        y[:, i] = acc
    y = np.clip(np.rint(y.ravel()), -32768, 32767).astype(np.int16)
    out = -(-lengths * up // down)
    keep = np.repeat(first * up // down - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
    return y[keep], out


def decode(raw: np.ndarray, offsets: np.ndarray, codec: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray]:
    """(samples, samples in each) of payloads by codec number; another number gives no samples."""
    size = np.diff(offsets)
    lengths = np.where(codec == 2, adpcm_lengths(size), np.where((codec == 0) | (codec == 1), size, 0))
    out = np.zeros(int(lengths.sum()), np.int16)
    owner = np.repeat(codec, lengths)
    by_byte = np.repeat(codec, size)
    out[owner == 0] = mulaw_table()[raw[by_byte == 0]]
    out[owner == 1] = alaw_table()[raw[by_byte == 1]]
    third = np.flatnonzero(codec == 2)
    if len(third):
        out[owner == 2] = decode_adpcm(raw, offsets[third], size[third])[0]
    return resample(out, lengths, rate_in, rate_out)


def decode_telephony(rows: DataFrame, id_col: str = "id", payload_col: str = "payload", codec_col: str = "codec", rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> DataFrame:
    """(id, codec, sample_rate, n_samples, pcm) of each row; pcm is 16-bit little-endian, one channel.

    A null payload, and a codec that is null or not one of CODECS, give null
    n_samples and pcm; an empty payload gives 0 and no bytes.  An ADPCM
    payload's last block may be short; under 4 bytes it has no samples.
    Repeated rows are decoded each; other columns aren't read.  An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets, valid = B.text_buffers(batch.column(1))
            names = batch.column(2)
            codec = np.array([CODECS.index(c) if c in CODECS else -1 for c in names.to_pylist()], np.int64)
            for i, j in B.doc_chunks(offsets, CHUNK):
                samples, n = decode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], codec[i:j], rate_in, rate_out)
                none = ~valid[i:j] | (codec[i:j] < 0)
                ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int64)
                bits = np.packbits(~none, bitorder="little")
                pcm = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [pa.py_buffer(bits), pa.py_buffer(ends), pa.py_buffer(samples.astype("<i2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), names.slice(i, j - i), pa.array(np.full(j - i, rate_out, np.int32)), pa.array(n, mask=none), pcm], [id_col, "codec", "sample_rate", "n_samples", "pcm"])

    wanted = rows.select(F.col(id_col), F.col(payload_col).cast("binary").alias("_sl_payload"), F.col(codec_col).cast("string").alias("codec"))
    return wanted.mapInArrow(run, f"`{id_col}` {wanted.schema[0].dataType.simpleString()}, codec string, sample_rate int, n_samples long, pcm binary")
