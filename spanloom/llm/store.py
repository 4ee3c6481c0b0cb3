"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of up to so many rows (about 40 bytes each in a hash table) may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch that a worker is given at once; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of bounded bytes, whatever the length of texts; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, which Spark keeps, gives the memory that it has freed back to the system."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):  # glibc's own
                libc.malloc_trim(0)

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column, with so many underscores behind it that it has none."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a new local one.

    On a cluster a folder of one machine wouldn't be seen by the others, so
    there the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_sl_shared", None)
        if not found:
            found = spark._sl_shared = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._sl_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._sl_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_size(ids: DataFrame, rows: int) -> DataFrame:
    """``ids`` with a broadcast hint where its counted rows are few enough."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids
