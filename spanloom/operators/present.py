"""Views for reports: wrapped lines, entities on a line, running counts, tails."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import rows_of
from spanloom.functions.offsets import _col


def wrap_ranges(text: str, width: int) -> list[tuple[int, int]]:
    """(start, end) of greedily wrapped lines in characters; a line break ends a line, a longer word is cut."""
    out, at = [], 0
    for line in text.split("\n"):
        start, stop = at, at + len(line)
        while stop - start > width:
            cut = text.rfind(" ", start, start + width + 1)
            end = cut if cut > start else start + width
            out.append((start, end))
            start = end + (cut > start)
        out.append((start, stop))
        at = stop + 1
    return out


def wrapped(text, width: int = 80) -> Column:
    """Array of (start, end) of a text's lines."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(x: pa.Array) -> pa.Array:
        found = [np.array([] if t is None else wrap_ranges(t, width), np.int32).reshape(-1, 2) for t in (v.as_py() for v in x)]
        flat = np.concatenate([np.zeros((0, 2), np.int32), *found])
        lines = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(2)], ["start", "end"])
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, lines, mask=x.is_null() if x.null_count else None)

    return run(_col(text))


def line_rows(docs: DataFrame, keys: tuple[str, ...], spans, width: int = 80, text_col: str = "text") -> DataFrame:
    """(keys, line, start, end, entities): a row for each wrapped line of a text, with how many of ``spans`` overlap it; all in characters.

    A line's spans are those that begin before its end without those that end
    at or before its start, so both are found by bisection.
    """

    def make(texts, found):
        lines, met, at = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], found.offsets.to_numpy()
        starts, ends = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
        for raw, a, b in zip(texts, at[:-1], at[1:]):
            own = np.array([] if raw is None else wrap_ranges(raw.decode("utf-8", "replace"), width), np.int64).reshape(-1, 2)
            lines.append(own)
            met.append(np.searchsorted(np.sort(starts[a:b]), own[:, 1], side="left") - np.searchsorted(np.sort(ends[a:b]), own[:, 0], side="right"))
        counts = np.array([len(x) for x in lines[1:]], np.int64)
        flat = np.concatenate(lines)
        return counts, [np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts), *(np.ascontiguousarray(flat[:, k]) for k in range(2)), np.concatenate(met)]

    bare = F.transform(_col(spans), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return rows_of(docs, keys, [_col(text_col).cast("binary"), bare], "line bigint, start bigint, end bigint, entities bigint", make)


def on_lines(lines, spans) -> Column:
    """For each line the spans that overlap it; null lines give null.  Lines and spans are worked out once, not once a line."""
    one = F.array(F.struct(_col(lines).alias("lines"), _col(spans).alias("spans")))

    def of(x):
        return F.transform(x["lines"], lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), F.filter(x["spans"], lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"])).alias("spans")))

    return F.transform(one, of)[0]


def found_so_far(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``entities`` with the count of those that end at or before each one's end, in its document."""
    return entities.withColumn("found", F.count("*").over(Window.partitionBy(id_col).orderBy("end")))


def latest(entities: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The n last entities of each document, latest first in ``rank``."""
    return entities.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("start"), F.desc("end"), "label"))).filter(F.col("rank") <= n)
