"""Redaction: spans sorted, swept by a cursor, and replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.functions.offsets import BYTES, _col, cut, size


def sweep(text, spans, unit: str = BYTES) -> Column:
    """Spans in the order of start, longer first, each with ``from``: where the text before it begins.

    A span that ends at or before the cursor is left out; one that begins
    before the cursor and ends behind it stays and has no text before it.
    """
    whole = size(text, unit)
    valid = F.filter(_col(spans), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= whole))
    keyed = F.array_sort(F.transform(valid, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("back"), s["label"].alias("label"))))
    none = F.transform(F.filter(keyed, lambda _: F.lit(False)), lambda s: F.struct(s["start"].alias("from"), s["start"].alias("start"), s["start"].alias("end"), s["label"].alias("label")))

    def step(acc, s):
        kept = F.struct(acc["cursor"].alias("from"), s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label"))
        on = -s["back"] > acc["cursor"]
        return F.struct(F.when(on, -s["back"]).otherwise(acc["cursor"]).alias("cursor"), F.when(on, F.array_append(acc["out"], kept)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(keyed, F.struct(F.lit(0).alias("cursor"), none.alias("out")), step, lambda acc: acc["out"])


def redact(text, spans, replacement: str | None = "***", unit: str = BYTES) -> Column:
    """The text with each swept span replaced; by its label's tag where ``replacement`` is None.

    A null text gives null; null or no spans give the text as it is.
    """
    found = F.coalesce(sweep(text, spans, unit), F.array().cast("array<struct<from:int,start:int,end:int,label:string>>"))
    stands = (lambda s: L.redaction_tag(s["label"])) if replacement is None else (lambda s: F.lit(replacement))
    # the text before a span is cut only where there is some: a span may begin before the cursor
    pieces = F.transform(found, lambda s: F.concat(F.when(s["start"] > s["from"], cut(text, s["from"], s["start"], unit)).otherwise(F.lit("")), stands(s)))
    last = F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), cut(text, last, size(text, unit), unit))


def mask(text, spans, block: str = "█", unit: str = "chars") -> Column:
    """The text with each character of a swept span as a block."""
    found = F.coalesce(sweep(text, spans, unit), F.array().cast("array<struct<from:int,start:int,end:int,label:string>>"))
    pieces = F.transform(
        found,
        lambda s: F.concat(F.when(s["start"] > s["from"], cut(text, s["from"], s["start"], unit)).otherwise(F.lit("")), F.repeat(F.lit(block), F.char_length(cut(text, F.greatest(s["start"], s["from"]), s["end"], unit)))),
    )
    last = F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), cut(text, last, size(text, unit), unit))
