"""Token counts under a public byte-level BPE vocabulary.

Two tiers, both on the map side.  Tier one is a compact open-addressed table
of the corpus's frequent pre-tokens, broadcast to all executors: exact keys of
up to 16 bytes in two 64-bit words, looked up for a whole batch at once.  What
it misses is encoded by the worker and kept in the worker's cache.  No
pre-token row is ever shuffled: the frequent ones are found from one summary
of fixed size a task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.llm import bytesops as B
from spanloom.llm.store import free_name, trimmed

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pre-tokens in the broadcast table; its size in bytes is about 40 times this, whatever the corpus.
TABLE_SIZE = 1 << 16
#: Pre-tokens that a task's summary may hold.
SUMMARY_SIZE = 1 << 14
#: Summaries that are merged at once.
MERGED = 16
#: Pre-tokens that a worker's cache may hold before it is emptied.
CACHE_SIZE = 1 << 20
KEY_BYTES = 16

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoder of a ranks file, one a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point as the encoder's own regular expressions see it."""
    import tiktoken

    every = B.every_character()
    table = np.full(0x110000, OTHER, np.uint8)
    for what, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(only.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = what
    return table


@lru_cache(maxsize=1)
def _ascii_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[:128] = char_classes()[:128]
    return out


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte: that of the character that it belongs to."""
    cls = _ascii_classes()[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        buf = B.padded(raw)
        b0 = raw[lead].astype(np.int64)
        b1, b2, b3 = (buf[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 0x1F) << 6 | b1, np.where(three, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        c = char_classes()[np.minimum(cp, 0x10FFFF)]
        cls[lead] = c
        cls[lead + 1] = c
        cls[lead[~two] + 2] = c[~two]
        cls[lead[~three] + 3] = c[~three]
    return cls


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every pre-token under PATTERN, in no set order."""
    n = len(raw)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    cls = byte_classes(raw)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    first = offsets[:-1][offsets[:-1] < n]
    edge[first] = True
    s = np.flatnonzero(edge)
    e = np.append(s[1:], n)
    c = cls[s]
    doc = np.searchsorted(offsets, s, side="right") - 1
    m = len(s)
    follows = np.zeros(m, bool)  # a run of spaces with more of the document behind it
    follows[:-1] = (c[:-1] == SPACE) & (doc[1:] == doc[:-1])
    j = np.flatnonzero(follows)
    blank = raw[e[j] - 1] == 0x20
    lend = j[blank]  # its last space goes to the next run
    e[lend] -= 1
    s[lend + 1] -= 1
    spaced = np.zeros(m, bool)
    spaced[lend + 1] = True
    own = j[~blank]  # its last character stands alone
    size = np.ones(len(own), np.int64)
    for k in (1, 2, 3):
        size += ((size == k) & ((raw[np.maximum(e[own] - k, 0)] & 0xC0) == 0x80)).astype(np.int64)
    split = e[own] - s[own] > size
    own, size = own[split], size[split]
    more_s, more_e, more_d = e[own] - size, e[own].copy(), doc[own]
    e[own] -= size
    q = np.flatnonzero((c[:-1] == OTHER) & (e[:-1] - s[:-1] == 1) & ~spaced[:-1] & (c[1:] == LETTER) & (doc[1:] == doc[:-1]))
    q = q[raw[s[q]] == 0x27]
    if len(q):
        a = raw[s[q] + 1]
        room = e[q + 1] - s[q + 1] > 1
        b = np.where(room, raw[np.minimum(s[q] + 2, n - 1)], 0)
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        take = np.where(one, 1, np.where(two, 2, 0))
        e[q] += take
        s[q + 1] += take
    keep = e > s
    return np.concatenate([s[keep], more_s]), np.concatenate([e[keep], more_e]), np.concatenate([doc[keep], more_d])


def keys(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of slices of up to 16 bytes as two 64-bit words."""
    view = B.words_at(buf)
    return view[start] & B.low_bytes(length), view[start + 8] & B.low_bytes(length - 8)


class PieceTable:
    """Open-addressed table from pre-token bytes to token count; keys are compared whole."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, tokens: np.ndarray):
        bits = max(4, int(len(lo) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.lo, self.hi = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size, self.tokens = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.uint8)
        self.probes = 1
        for i, at in enumerate(self._slot(lo, hi, size).tolist()):
            k = 0
            while self.size[(at + k) & self.mask]:
                k += 1
            at = (at + k) & self.mask
            self.lo[at], self.hi[at], self.size[at], self.tokens[at] = lo[i], hi[i], size[i], tokens[i]
            self.probes = max(self.probes, k + 1)

    def _slot(self, lo, hi, size):
        x = (lo * _K[0]) ^ (hi * _K[1]) ^ (size.astype(np.uint64) * _K[2])
        x ^= x >> np.uint64(29)
        return ((x * _K[0]) >> self.shift).astype(np.int64)

    def get(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts, 0 for a key that isn't there."""
        at = self._slot(lo, hi, size)
        hit = (self.lo[at] == lo) & (self.hi[at] == hi) & (self.size[at] == size)
        out = np.where(hit, self.tokens[at], 0).astype(np.int64)
        rest = np.flatnonzero(~hit & (self.size[at] != 0))
        for _ in range(1, self.probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & self.mask
            r = at[rest]
            hit = (self.lo[r] == lo[rest]) & (self.hi[r] == hi[rest]) & (self.size[r] == size[rest])
            out[rest[hit]] = self.tokens[r[hit]]
            rest = rest[~hit & (self.size[r] != 0)]
        return out


def _piece_length(enc, piece: bytes) -> int:
    return len(enc._core_bpe.encode_single_piece(piece))


def _top(lo, hi, size, count, most):
    """Equal keys summed; the ``most`` most frequent, ties by key."""
    order = np.lexsort((size, hi, lo))
    lo, hi, size, count = lo[order], hi[order], size[order], count[order]
    new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (size[1:] != size[:-1])) if len(lo) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    total = np.add.reduceat(count, at) if len(at) else count
    lo, hi, size = lo[at], hi[at], size[at]
    if len(lo) > most:
        best = np.sort(np.argsort(-total, kind="stable")[:most])
        lo, hi, size, total = lo[best], hi[best], size[best], total[best]
    return lo, hi, size, total


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts, all of them, the most frequent pre-tokens of up to 16 bytes."""
    z = np.zeros(0, np.uint64)
    have = (z, z, np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        raw, offsets, _ = B.text_buffers(batch.column(0))
        for i, j in B.doc_chunks(offsets):
            part = raw[offsets[i] : offsets[j]]
            s, e, _ = pretokens(part, offsets[i : j + 1] - offsets[i])
            size = e - s
            short = size <= KEY_BYTES
            s, size = s[short], size[short]
            lo, hi = keys(B.padded(part), s, size)
            # equal 64-bit mixes are summed under the first one's key; a clash only miscounts a candidate
            mixed, at, count = np.unique(B.mix64(lo ^ (hi * _K[1]) ^ size.astype(np.uint64)), return_index=True, return_counts=True)
            new = (lo[at], hi[at], size[at], count.astype(np.int64))
            if len(mixed) > 4 * SUMMARY_SIZE:
                best = np.argpartition(-count, 4 * SUMMARY_SIZE)[: 4 * SUMMARY_SIZE]
                new = tuple(x[best] for x in new)
            have = _top(*(np.concatenate([a, b]) for a, b in zip(have, new)), 4 * SUMMARY_SIZE)
    yield _summary(*_top(*have, SUMMARY_SIZE))


def _summary(lo, hi, size, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.stack([lo, hi, size.astype(np.uint64), count.astype(np.uint64)]).tobytes()], pa.binary())], ["summary"])


def merged(most: int):
    """Summaries of several tasks as one, of ``most`` pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            for blob in batch.column(0):
                lo, hi, size, count = np.frombuffer(blob.as_buffer(), np.uint64).reshape(4, -1)
                new = (lo, hi, size.astype(np.int64), count.astype(np.int64))
                have = new if have is None else _top(*(np.concatenate([a, b]) for a, b in zip(have, new)), most)
        if have is not None:
            yield _summary(*have)

    return run


def frequent_table(docs: DataFrame, text_col: str = "text", ranks_path: str = DEFAULT_RANKS, table_size: int = TABLE_SIZE) -> PieceTable:
    """Tier one for this corpus.  Which keys it holds changes the speed, never a count.

    Summaries are merged MERGED at a time until so few are left; each is one
    value of bounded size, and no pre-token is a key of any shuffle.
    """
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(summaries), "summary binary")
    tasks = docs._jdf.queryExecution().toRdd().getNumPartitions()
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        found = found.repartition(tasks).mapInArrow(trimmed(merged(4 * table_size)), "summary binary")
    lo, hi, size, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for row in found.toLocalIterator():
        new = np.frombuffer(row.summary, np.uint64).reshape(4, -1)
        lo, hi, size, count = _top(*(np.concatenate([a, b.astype(a.dtype)]) for a, b in zip((lo, hi, size, count), new)), 4 * table_size)
    lo, hi, size, count = _top(lo, hi, size, count, table_size)
    enc, tokens = encoder(ranks_path), np.zeros(len(lo), np.int64)
    raw = np.stack([lo, hi], axis=1).astype("<u8").tobytes()
    for i, k in enumerate(size.tolist()):
        tokens[i] = _piece_length(enc, raw[16 * i : 16 * i + k])
    return PieceTable(lo, hi, size, tokens)


class Counter:
    """Counts tokens of a batch; keeps what tier one misses in the worker."""

    cache: dict[str, dict[bytes, int]] = {}

    def __init__(self, table: PieceTable, ranks_path: str):
        self.table, self.enc = table, encoder(ranks_path)
        self.seen = self.cache.setdefault(ranks_path, {})

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in B.doc_chunks(offsets):
            part = raw[offsets[i] : offsets[j]]
            s, e, doc = pretokens(part, offsets[i : j + 1] - offsets[i])
            if not len(s):
                continue
            size = e - s
            short = size <= KEY_BYTES
            buf, n = B.padded(part), np.zeros(len(s), np.int64)
            lo, hi = keys(buf, s[short], size[short])
            n[short] = self.table.get(lo, hi, size[short])
            miss = np.flatnonzero(n == 0)
            if len(miss):
                n[miss] = self._encode(part.tobytes(), s[miss].tolist(), e[miss].tolist())
            out[i:j] = np.bincount(doc, weights=n, minlength=j - i).astype(np.int64)
        return out

    def _encode(self, text: bytes, start: list[int], end: list[int]) -> list[int]:
        seen, enc, out = self.seen, self.enc, []
        if len(seen) > CACHE_SIZE:
            seen.clear()
        for a, b in zip(start, end):
            piece = text[a:b]
            k = seen.get(piece)
            if k is None:
                k = _piece_length(enc, piece)
                if len(piece) <= 256:
                    seen[piece] = k
            out.append(k)
        return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(id, n_tokens) of each row of ``docs``, in full and without a shuffle of rows.

    One row comes out for each row that goes in, repeated rows included, and
    only the two named columns are read.  A null text gives a null count, an
    empty one 0; a null id stays null.  An empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, ranks_path, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value, ranks_path)
        for batch in batches:
            raw, offsets, valid = B.text_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(raw, offsets), mask=~valid)], [id_col, "n_tokens"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_sl_text"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(trimmed(count), f"`{id_col}` {kind}, n_tokens long")


def with_tokens(docs: DataFrame, out_col: str = "n_tokens", text_col: str = "text", ranks_path: str = DEFAULT_RANKS, table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with its columns and each row's tokens as ``out_col``, counted as ``count_tokens`` does, in the row: no id is needed."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, ranks_path, table_size))
    base = docs.drop(out_col)
    wanted = base.withColumn(free_name(base, "_sl_text"), F.col(text_col).cast("string"))
    schema = StructType([*base.schema.fields, StructField(out_col, LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value, ranks_path)
        for batch in batches:
            raw, offsets, valid = B.text_buffers(batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counter(raw, offsets), mask=~valid)], schema.names)

    return wanted.mapInArrow(trimmed(count), schema)
