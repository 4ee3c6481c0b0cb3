"""Pre-tokenisation: one ordered alternation that parts a text without gaps.

For valid UTF-8 it is a JVM regular expression over the whole text.  Bytes
that aren't UTF-8 take the Arrow path, in which each bad byte is a character
of no class.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.arrays import running_sums
from spanloom.functions.offsets import _col

#: White_Space of the Unicode database; neither Java's \s nor Python's isspace() is the same.
SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UPPER, LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
SUFFIX = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
LEAD = r"[^\r\n\p{L}\p{N}]?"

ALTERNATIVES = (
    f"{LEAD}{UPPER}*{LOWER}+{SUFFIX}",
    f"{LEAD}{UPPER}+{LOWER}*{SUFFIX}",
    r"\p{N}{1,3}",
    rf" ?[^{SPACE}\p{{L}}\p{{N}}]+[\r\n/]*",
    rf"[{SPACE}]*[\r\n]+",
    rf"[{SPACE}]+(?![^{SPACE}])",
    rf"[{SPACE}]+",
)
PATTERN = "|".join(ALTERNATIVES)


def pieces(text) -> Column:
    """Pre-tokens as an array of strings; joined they are the text."""
    return F.regexp_extract_all(_col(text), F.lit(PATTERN), F.lit(0))


def spans_of(found: Column) -> Column:
    """Array of (start, end, piece) in bytes for pieces that part a text."""
    ends = running_sums(F.transform(found, lambda p: F.octet_length(p)))
    return F.zip_with(found, ends, lambda p, e: F.struct((e - F.octet_length(p)).alias("start"), e.alias("end"), p.alias("piece")))


def pretokens(text) -> Column:
    """Array of (start, end, piece); '' gives an empty array, null gives null."""
    return spans_of(pieces(text))


@lru_cache(maxsize=1)
def _compiled():
    import regex

    return regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", PATTERN))


def _decode(raw: bytes) -> tuple[str, np.ndarray]:
    """(text with a lone surrogate for each bad byte, byte offset of each character and of the end)."""
    text = raw.decode("utf-8", "surrogateescape")
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    sizes[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1
    return text, np.concatenate([[0], np.cumsum(sizes)])


def byte_spans(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the pre-tokens of bytes, valid UTF-8 or not."""
    text, at = _decode(raw)
    return [(int(at[m.start()]), int(at[m.end()])) for m in _compiled().finditer(text)]


def pretokens_of_bytes(raw) -> Column:
    """Array of (start, end) for a binary column that may hold anything."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([None if b is None else [{"start": s, "end": e} for s, e in byte_spans(b)] for b in column.to_pylist()], kind)

    return run(_col(raw))
