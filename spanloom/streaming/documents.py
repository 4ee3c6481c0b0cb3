"""Documents as a stream: classification and redaction need no state, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.engine import Engine


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def redact_stream(docs: DataFrame, engine: Engine | None = None, **options) -> DataFrame:
    """A stream of documents with entities and redacted text."""
    return (engine or Engine()).redact(docs, **options)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What has arrived so far, written as Parquet, each row once; the checkpoint is in a shared folder."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
