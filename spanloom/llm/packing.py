"""Packing documents into training windows by best fit, longest first.

Overlong documents are first cut into full windows; what remains is packed by
best-fit decreasing over the whole corpus, not within partitions.  That is
possible as pieces of one length are alike: the plan is made on the driver
from the count of pieces of each length (one a token length, whatever the
corpus holds), with open windows kept as ranges of alike windows.  A segment
tree indexed by remaining capacity finds the tightest open ones.  Executors
then number the pieces of each length and look their windows up in the plan.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import materialise, trimmed
from spanloom.llm.tokencount import DEFAULT_RANKS, count_tokens

CAPACITY = 2048
#: Pieces of one length are numbered in hash buckets of about so many rows, so that a common length is no single task.
BUCKET_ROWS = 50_000


class CapacityTree:
    """Segment tree over remaining capacities 0..n: the least one >= r that has open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, r: int, open_: bool) -> None:
        i = r + self.size
        self.any[i] = open_
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, r: int) -> int:
        """-1 if there is none."""
        i = r + self.size
        if self.any[i]:
            return r
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Plan:
    """Runs of pieces, sorted by length and rank: rank first..first+count-1 of a length, ``each`` to a window."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int
    stride: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset in it) of pieces."""
        at = np.searchsorted(self.length * self.stride + self.first, length * self.stride + rank, side="right") - 1
        past = rank - self.first[at]
        return self.window[at] + past // self.each[at], self.offset[at] + (past % self.each[at]) * length


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing of ``counts[n]`` pieces of each length n."""
    tree = CapacityTree(capacity)
    open_: list[deque] = [deque() for _ in range(capacity + 1)]
    runs, windows = [], 0

    def put(r, first, many):
        if r and many:
            if not open_[r]:
                tree.set(r, True)
            open_[r].append((first, many))

    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        while left:
            r = tree.tightest(n)
            if r < 0:  # new windows for all that is left
                r, each = capacity, capacity // n
                start, many = windows, -(-left // each)
                windows += many
            else:
                each = r // n
                start, many = open_[r].popleft()
            # a window of remainder r stays the tightest while it can take another piece
            full = min(many, left // each)
            rest = min(each, left - full * each) if full < many else 0
            taken = full * each + rest
            runs.append((n, rank, each, start, capacity - r))
            put(r - each * n, start, full)
            if rest:
                put(r - rest * n, start + full, 1)
            if many - full - bool(rest):
                open_[r].appendleft((start + full + bool(rest), many - full - bool(rest)))
            elif r < capacity or not open_[r]:
                if not open_[r]:
                    tree.set(r, False)
            rank += taken
            left -= taken
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*cols, windows, max([1, *counts.values()]) + 1)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, ranks_path: str = DEFAULT_RANKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(window_id, window_offset, id, token_start, n_tokens) of every piece of every document.

    Token counts are those of the tokenizer, or of ``tokens_col`` where given.
    A document of n tokens gives n // capacity full pieces and one of what
    remains; one without tokens, or of a null text, gives none.  Pieces of one
    length are alike; which of them goes to which window is decided by their
    ids' hashes, then ids.  Repeated rows are packed each; a null id is kept.
    Other columns aren't read.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("n")) if tokens_col else count_tokens(docs, id_col, text_col, ranks_path).toDF("id", "n")
    # rows of one id and size are one row with their number, so that no id is a task's undoing
    sized = materialise(counted.filter("n > 0").groupBy("id", "n").agg(F.count("*").alias("rows")), "sizes")
    # all full pieces of a document are one row, as their windows follow each other
    full = sized.filter(f"n >= {capacity}").selectExpr("id", "n", "rows", "0L AS token_start", f"{capacity}L AS length", f"n DIV {capacity} AS each")
    rest = sized.filter(f"n % {capacity} > 0").selectExpr("id", "n", "rows", f"n - n % {capacity} AS token_start", f"n % {capacity} AS length", "1L AS each")
    pieces = full.unionByName(rest)
    lengths = pieces.groupBy("length").agg(F.sum(F.col("each") * F.col("rows")).cast("long").alias("pieces"), F.count("*").alias("rows")).toPandas().astype(np.int64)
    buckets = np.ones(capacity + 1, np.int64)
    buckets[lengths.length] = -(-lengths.rows // bucket_rows)
    numbered = pieces.withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(id, n), element_at(array({', '.join(map(str, buckets[1:].tolist()))}), CAST(length AS INT))) AS INT)")) if buckets.max() > 1 else pieces.withColumn("bucket", F.lit(0))
    found = numbered.groupBy("length", "bucket").agg(F.sum(F.col("each") * F.col("rows")).cast("long").alias("n")).toPandas().astype(np.int64).sort_values(["length", "bucket"])
    first = np.cumsum(buckets) - buckets  # a bucket's place among those of all lengths
    before = np.zeros(int(buckets.sum()), np.int64)
    if len(found):
        length, bucket, n = (found[c].to_numpy() for c in ("length", "bucket", "n"))
        total = np.cumsum(n) - n
        start = np.searchsorted(length, length)
        before[first[length] + bucket] = total - total[start]
    shared = docs.sparkSession.sparkContext.broadcast((plan_windows(dict(zip(lengths.length.tolist(), lengths.pieces.tolist())), capacity), first, before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first, before = shared.value
        for batch in batches:
            start, size, each, rows, bucket, rank = (c.to_numpy() for c in batch.columns[1:])
            many = each * rows
            begin = before[first[size] + bucket] + rank
            # some rows stand for very many pieces, so rows are cut to runs of bounded size
            done = 0
            ends = np.cumsum(many)
            while done < (ends[-1] if len(ends) else 0):
                stop = min(done + (1 << 16), int(ends[-1]))
                at = np.arange(done, stop)
                row = np.searchsorted(ends, at, side="right")
                past = at - (ends[row] - many[row])
                window, offset = plan.place(size[row], begin[row] + past)
                yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(offset), batch.column(0).take(pa.array(row)), pa.array(start[row] + past % each[row] * size[row]), pa.array(size[row])], ["window_id", "window_offset", id_col, "token_start", "n_tokens"])
                done = stop

    rank = F.coalesce(F.sum(F.col("each") * F.col("rows")).over(Window.partitionBy("length", "bucket").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.select("id", "token_start", "length", "each", "rows", "bucket", rank.cast("long").alias("rank")).mapInArrow(trimmed(assign), f"window_id long, window_offset long, `{id_col}` {kind}, token_start long, n_tokens long")
