"""Array functions that Catalyst has no linear form of, over whole Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that a worker is given at once; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes of texts that are worked out together, where one text isn't longer.
PART_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of bounded bytes, whatever the length of texts; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this worker, which Spark keeps, has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc's own
        libc.malloc_trim(0)


def parts_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rows in a row of at most so many bytes together; a larger row stands alone."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b
        a = b


def rows_of(rows: DataFrame, keys: tuple[str, ...], columns: list[Column], fields: str, make: Callable[..., tuple[np.ndarray, list]]) -> DataFrame:
    """``keys`` and ``fields``, a row for each thing that ``make`` finds in the texts (binary) that are the first of ``columns``.

    ``make`` takes a list of texts and an Arrow array for each other column,
    and gives how many things each row has and an array for each field.  It is
    given PART_BYTES of texts at once, so its memory doesn't grow with a batch.
    """
    bounded_batches(rows.sparkSession)
    names = [f"_c{i}" for i in range(len(columns))]
    laid = rows.select(*(F.col(k) for k in keys), *(c.alias(n) for c, n in zip(columns, names)))
    own = T._parse_datatype_string(fields)
    schema = T.StructType([*laid.schema.fields[: len(keys)], *own.fields])
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in own.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                sizes = pc.binary_length(batch.column(len(keys))).fill_null(0).to_numpy(zero_copy_only=False)
                for a, b in parts_of(sizes.astype(np.int64), PART_BYTES):
                    part = batch.slice(a, b - a)
                    counts, values = make(part.column(len(keys)).to_pylist(), *part.columns[len(keys) + 1 :])
                    at = pa.array(np.repeat(np.arange(b - a), counts))
                    arrays = [part.column(i).take(at) for i in range(len(keys))] + [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(values, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
        finally:
            give_back()

    return laid.mapInArrow(run, schema)


def sums_of_lists(column: pa.Array) -> pa.Array:
    """Running sums in each list; one pass over the values of the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    total = np.cumsum(flat)
    first = np.cumsum(lengths) - lengths
    base = np.where(first > 0, total[np.maximum(first, 1) - 1] if len(total) else 0, 0)
    out = (total - np.repeat(base, lengths)).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(out))
    if column.null_count == 0:
        return made
    mask = pa.array(~column.is_valid().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=mask)


def running_sums(column: Column) -> Column:
    """array<int> of running sums; null gives null."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        return sums_of_lists(x)

    return run(column)
