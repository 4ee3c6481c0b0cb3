"""Byte-pair encoding of pre-tokens.

Vocabulary and merges are fixed in size, so they are sent to each executor
once; each worker keeps what it has encoded, so that a pre-token is merged
once a worker and no pre-token row is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.arrays import bounded_batches, parts_of, rows_of
from spanloom.functions.offsets import _col
from spanloom.functions.pretoken import _compiled, byte_spans

#: Pre-tokens that a worker keeps.
CACHE_SIZE = 1 << 18
#: Bytes of a pre-token up to which lists are faster than a heap.
SHORT = 32
NEVER = 1 << 62
#: Bytes of texts that are encoded together, where one text isn't longer.
TEXT_BYTES = 1 << 20
TOKENS = "array<struct<id:int,start:int,end:int>>"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """ids of byte pieces and ranks of pairs; without ranks of its own, a pair's rank is the id of both together."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int] | None = None
    cache: dict[bytes, np.ndarray] = field(default_factory=dict, compare=False, repr=False)
    table: PieceTable | None = field(default=None, compare=False, repr=False)
    numbered: tuple | None = field(default=None, compare=False, repr=False)

    def rank(self, a: bytes, b: bytes) -> int | None:
        return self.ids.get(a + b) if self.ranks is None else self.ranks.get((a, b))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "table": None, "numbered": None}

    def encode(self, piece: bytes) -> np.ndarray:
        """(tokens, 3): id, start, end of the tokens of a pre-token, offsets widened to whole characters."""
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) > CACHE_SIZE:
                self.cache.clear()
            found = np.array(self._merge(piece), np.int32).reshape(-1, 3)
            widen(piece, found)
            if len(piece) <= 256:
                self.cache[piece] = found
        return found

    def _merge(self, piece: bytes) -> list[tuple[int, int, int]]:
        if not piece:
            return []
        if (whole := self.ids.get(piece)) is not None:
            return [(whole, 0, len(piece))]
        n = len(piece)
        if n <= SHORT and self.ranks is not None:
            return self._merge_short(piece)
        end, before, after, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i):
            j = after[i]
            if j < n and (r := self.rank(piece[i : end[i]], piece[j : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[i] != mid or end[j] != stop:
                continue  # one of the two has been merged since
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            known = self.ids.get(piece[i : end[i]])
            out += [(known, i, end[i])] if known is not None else [(self.ids.get(piece[k : k + 1], 0), k, k + 1) for k in range(i, end[i])]
            i = after[i]
        return out

    def _symbols(self) -> tuple:
        """Numbers in place of bytes: of each byte, and by a pair's numbers its rank and the number of both together; by number the id and the length."""
        if self.numbered is None:
            parts = dict.fromkeys([*(bytes([b]) for b in range(256)), *self.ids, *(x for a, b in self.ranks for x in (a, b, a + b))])
            number = {p: i for i, p in enumerate(parts)}
            keys = {number[a] << 32 | number[b]: (r, number[a + b]) for (a, b), r in self.ranks.items()}
            self.numbered = (list(range(256)), {k: r for k, (r, _) in keys.items()}, {k: m for k, (_, m) in keys.items()}, [self.ids.get(p) for p in parts], [len(p) for p in parts])
        return self.numbered

    def _merge_short(self, piece: bytes) -> list[tuple[int, int, int]]:
        """The same over lists of numbers: of the pairs of the least rank the leftmost, again and again."""
        of_byte, rank, both, ids, sizes = self._symbols()
        parts = [of_byte[b] for b in piece]
        ranks = [rank.get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            parts[i] = new = both[parts[i] << 32 | parts.pop(i + 1)]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 32 | new, NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(new << 32 | parts[i + 1], NEVER)
        out, at = [], 0
        for p in parts:
            known, end = ids[p], at + sizes[p]
            if known is not None:
                out.append((known, at, end))
            else:
                out += [(self.ids.get(piece[k : k + 1], 0), k, k + 1) for k in range(at, end)]
            at = end
        return out


class PieceTable:
    """Tokens of the pre-tokens that a worker has met, in flat arrays; a pre-token's code is its place."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.sizes, self.counts, self.firsts, self.flat = array("i"), array("i"), array("q"), array("i")

    def add(self, piece: str) -> int:
        """The code of a pre-token, new or not."""
        if (code := self.codes.get(piece)) is not None:
            return code
        raw = piece.encode()
        found = self.vocabulary._merge(raw)
        if not piece.isascii():
            widened = np.array(found, np.int32).reshape(-1, 3)
            widen(raw, widened)
            found = widened.tolist()
        code = self.codes[piece] = len(self.sizes)
        self.sizes.append(len(raw))
        self.counts.append(len(found))
        self.firsts.append(len(self.flat) // 3)
        self.flat.extend(chain.from_iterable(found))
        return code

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray] | None:
        """What ``encode_texts`` gives; None if a text isn't UTF-8."""
        if len(self.codes) > CACHE_SIZE or len(self.flat) > 24 * CACHE_SIZE:
            self.clear()
        find, pieces, ends = _compiled().findall, [], [0]
        try:
            for raw in texts:
                if raw:
                    pieces += find(raw.decode())
                ends.append(len(pieces))
        except UnicodeDecodeError:
            return None
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        for i in np.flatnonzero(codes < 0).tolist():
            codes[i] = self.add(pieces[i])
        del pieces
        sizes, counts, firsts = (np.frombuffer(x, x.typecode)[codes] if len(codes) else np.zeros(0, np.int64) for x in (self.sizes, self.counts, self.firsts))
        passed = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ends = np.array(ends)
        before = passed[ends[:-1]]
        if not np.array_equal(passed[ends[1:]] - before, [len(raw or b"") for raw in texts]):
            return None  # something lies between pre-tokens
        base = passed[:-1] - np.repeat(before, np.diff(ends))
        past = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.arange(past[-1]) + np.repeat(firsts - past[:-1], counts)
        out = np.frombuffer(self.flat, np.int32).reshape(-1, 3)[at] if len(at) else np.zeros((0, 3), np.int32)
        out[:, 1:] += np.repeat(base, counts).astype(np.int32)[:, None]
        return out, past[ends].astype(np.int32)


def load_tokenizer_json(path: str) -> Vocabulary:
    """Vocabulary and merges of a byte-level BPE in a tokenizer.json."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Vocabulary({raw(k): v for k, v in model["vocab"].items() if all(c in alphabet for c in k)}, {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)})


def load_ranks(path: str) -> Vocabulary:
    """The vocabulary of a ranks file: base64 of a piece and its id on each line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def vocabulary_of(tokens: list[str], merges: list[str]) -> Vocabulary:
    """A vocabulary from token and merge strings in the byte alphabet, ids by place."""
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    ids = {}
    for i, t in enumerate(tokens):
        if all(c in alphabet for c in t):
            ids.setdefault(raw(t), i)
    return Vocabulary(ids, {(raw(a), raw(b)): r for r, (a, b) in enumerate(m.split(" ", 1) for m in merges)})


def widen(raw: bytes, tokens: np.ndarray) -> None:
    """Starts and ends within a character go to its edges."""
    inner = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
    inner[0] = False
    if inner.any():
        n = len(raw)
        low = np.maximum.accumulate(np.where(inner, 0, np.arange(n + 1)))
        high = n - np.maximum.accumulate(np.where(inner, 0, np.arange(n, -1, -1))[::-1])[::-1]
        tokens[:, 1], tokens[:, 2] = low[tokens[:, 1]], high[tokens[:, 2]]


def encode_texts(vocabulary: Vocabulary, texts: list[bytes | None], spans: Callable = byte_spans) -> tuple[np.ndarray, np.ndarray]:
    """((tokens, 3) of id, start, end, where each text's end) of all texts; tokens may overlap in a character."""
    if spans is byte_spans:
        if vocabulary.table is None:
            vocabulary.table = PieceTable(vocabulary)
        if (made := vocabulary.table.encode(texts)) is not None:
            return made
    parts, base, ends, torn, encode = [], [], [0], [], vocabulary.encode
    total = 0
    for i, raw in enumerate(texts):
        for s, e in spans(raw) if raw else ():
            if raw[s] & 0xC0 == 0x80:
                torn.append(i)  # bytes that aren't UTF-8 may part within a character
            found = encode(raw[s:e])
            parts.append(found)
            base.append(s)
            total += len(found)
        ends.append(total)
    flat = np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)
    flat[:, 1:] += np.repeat(np.array(base, np.int32), [len(x) for x in parts])[:, None]
    for i in set(torn):
        widen(texts[i], flat[ends[i] : ends[i + 1]])
    return flat, np.array(ends, np.int32)


def encode_bytes(vocabulary: Vocabulary, raw: bytes, spans: Callable = byte_spans) -> list[tuple[int, int, int]]:
    """(id, start, end) of a text; offsets are widened to whole characters, so tokens may overlap in one."""
    return [tuple(t) for t in encode_texts(vocabulary, [raw], spans)[0].tolist()]


def tokens(spark: SparkSession, text, vocabulary: Vocabulary) -> Column:
    """Array of (id, start, end) of each text (string or binary); null gives null, '' an empty array."""
    shared = spark.sparkContext.broadcast(vocabulary)
    bounded_batches(spark)

    @F.arrow_udf(TOKENS)
    def run(column: pa.Array) -> pa.Array:
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        made = [encode_texts(shared.value, column.slice(a, b - a).to_pylist()) for a, b in parts_of(sizes, TEXT_BYTES)]
        flat = np.concatenate([x for x, _ in made]) if made else np.zeros((0, 3), np.int32)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in made]))]).astype(np.int32) if made else np.zeros(1, np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["id", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=column.is_null() if column.null_count else None)

    return run(_col(text).cast("binary"))


def tokenize(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """``docs`` with the tokens of a text column."""
    return docs.withColumn(out_col, tokens(docs.sparkSession, text_col, vocabulary))


def token_rows(docs: DataFrame, vocabulary: Vocabulary, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(keys, id, start, end): a row for each token, made in the worker, so that no array of a text's tokens is passed on."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make(texts):
        flat, ends = encode_texts(shared.value, texts)
        return np.diff(ends), [np.ascontiguousarray(flat[:, k], np.int64) for k in range(3)]

    return rows_of(docs, keys, [_col(text_col).cast("binary")], "id bigint, start bigint, end bigint", make)


def vocabulary_hits(docs: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n, id) of the corpus's distinct pre-tokens joined with a vocabulary table (piece, id); id is null for a miss."""
    from spanloom.functions.pretoken import pieces

    found = docs.select(F.explode(pieces(text_col)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return found.join(ids, "piece", "left")
