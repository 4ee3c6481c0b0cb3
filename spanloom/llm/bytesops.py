"""Vectorised work on Arrow text columns: numpy over the UTF-8 buffer of a
whole batch, so that no Python object is made per word or per document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; keeps numpy's temporaries in the cache and
#: bounds a worker's memory whatever the Arrow batch holds.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null row is empty and not valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    n = len(column)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0], valid


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segments(raw: np.ndarray, limit: int, back: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes of one long text that end between words; each begins ``back`` words before the end of the one before it."""
    start, end, n = 0, 0, len(raw)
    while end < n:
        end = min(n, end + limit)
        while end < n:  # to the end of the word, however long
            gap = np.flatnonzero(~WORD_BYTE[raw[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + 4096)
        yield start, end
        look = 4096
        while end < n:
            a = max(0, end - look)
            while a and raw[a] & 0xC0 == 0x80:
                a -= 1
            begins = word_spans(raw[a:end], np.array([0, end - a]))[0]
            begins = begins[begins > 0] if a else begins  # the first may be the rest of a word
            if len(begins) >= back or a == 0:
                start = a + int(begins[-back]) if len(begins) >= back else 0
                break
            look *= 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def padded(raw: np.ndarray) -> np.ndarray:
    """The bytes with 32 zero bytes behind them, for reads of whole words past the end."""
    return np.concatenate([raw, np.zeros(32, np.uint8)])


def words_at(buf: np.ndarray) -> np.ndarray:
    """View of a padded buffer as the unaligned 64-bit word at each byte."""
    return np.ndarray((len(buf) - 8,), dtype="<u8", buffer=buf, strides=(1,))


def low_bytes(k: np.ndarray) -> np.ndarray:
    """Masks of the lowest k bytes, k clipped to 0..8."""
    return _LOW[np.clip(k, 0, 8)]


def hash_slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of a padded buffer, eight bytes a round."""
    view = words_at(buf)
    h = mix64((view[start] & low_bytes(length)) + length.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    at = 8
    rest = np.flatnonzero(length > at)
    while len(rest):
        piece = view[start[rest] + at] & low_bytes(length[rest] - at)
        h[rest] = mix64(h[rest] * U64(0x9E3779B97F4A7C15) ^ piece)
        at += 8
        rest = rest[length[rest] > at]
    return h


#: ASCII letters, digits and the underscore, and every byte of a non-ASCII character: no word ends within a run of these, but for characters that are words alone.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    WORD_BYTE[_c] = True

#: Scripts without spaces: each character is a word.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
WORD, ALONE = 1, 2


def every_character() -> str:
    """All code points but the surrogates, without an object for each."""
    return np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(maxsize=1)
def word_classes() -> np.ndarray:
    """Of each code point: whether it is part of a word (a letter, mark, digit or underscore), or a word alone."""
    import regex

    every = every_character()
    out = np.zeros(len(every), np.uint8)
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", every):
        out[m.start() : m.end()] = WORD
    for m in regex.finditer("[" + "".join(rf"\p{{{x}}}" for x in UNSPACED) + "]+", every):
        part = out[m.start() : m.end()]
        part[part == WORD] = ALONE
    return np.concatenate([out[:0xD800], np.zeros(0x800, np.uint8), out[0xD800:]])


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word of UTF-8 texts: a run of letters, marks, digits and underscores, or one character of a script without spaces.

    No word crosses documents.
    """
    n = len(raw)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    w = WORD_BYTE[raw]
    edge = np.zeros(n + 4, bool)  # a word may begin or end here though word bytes lie on both sides
    edge[offsets] = True
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        buf = padded(raw)
        b0 = raw[lead].astype(np.int64)
        b1, b2, b3 = (buf[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(size == 2, (b0 & 0x1F) << 6 | b1, np.where(size == 3, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = word_classes()[np.minimum(cp, 0x10FFFF)]
        none = kind == 0
        for k in range(4):
            at = lead[none & (size > k)] + k
            w[at[at < n]] = False
        alone = kind == ALONE
        edge[lead[alone]] = True
        edge[np.minimum(lead[alone] + size[alone], n)] = True
    prev, following = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], following[:-1] = w[:-1], w[1:]
    start = np.flatnonzero(w & (~prev | edge[:n]))
    end = np.flatnonzero(w & (~following | edge[1 : n + 1])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end - start, doc


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches in which equal keys lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == 0 and held:
                last = held[-1]
                if last.column(last.schema.get_field_index(key))[-1].as_py() != k[0]:
                    yield pa.Table.from_batches(held)
                    held = []
            elif held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
