"""Byte and code-point offsets of UTF-8 text.

Spans name their unit: ``bytes`` (half-open, into the UTF-8 bytes) or
``chars`` (half-open, into the code points).  All of this is JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES, CHARS = "bytes", "chars"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def byte_offset(text, chars) -> Column:
    """The byte offset of a code-point offset."""
    return F.octet_length(F.substring(_col(text), F.lit(1), _col(chars)))


def char_offset(text, at) -> Column:
    """The code points that end at or before a byte offset; a cut character doesn't count."""
    raw, at = _col(text).cast("binary"), _col(at)
    inside = F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    return F.char_length(F.substring(raw, F.lit(1), at).cast("string")) - F.when(inside, 1).otherwise(0)


def size(text, unit: str) -> Column:
    return F.octet_length(_col(text)) if unit == BYTES else F.char_length(_col(text))


def cut(text, start, end, unit: str) -> Column:
    """The text of a span."""
    start, end = _col(start), _col(end)
    if unit == BYTES:
        return F.substring(_col(text).cast("binary"), start + 1, end - start).cast("string")
    return F.substring(_col(text), start + 1, end - start)


def to_chars(text, spans) -> Column:
    """Spans of byte offsets with code-point offsets instead."""
    return F.transform(_col(spans), lambda s: s.withField("start", char_offset(text, s["start"])).withField("end", char_offset(text, s["end"])))


def to_bytes(text, spans) -> Column:
    """Spans of code-point offsets with byte offsets instead."""
    return F.transform(_col(spans), lambda s: s.withField("start", byte_offset(text, s["start"])).withField("end", byte_offset(text, s["end"])))
