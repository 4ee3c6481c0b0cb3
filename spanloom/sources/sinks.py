"""What goes out: entities as JSON, redacted text, predictions, summaries, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.offsets import BYTES, _col, cut


def entities_json(text, spans, unit: str = BYTES) -> Column:
    """A JSON array of entity_group, start, end, score (four decimals) and text; strings are escaped."""
    one = lambda s: F.struct(s["label"].alias("entity_group"), s["start"].alias("start"), s["end"].alias("end"), F.round(s["score"].cast("double"), 4).alias("score"), cut(text, s["start"], s["end"], unit).alias("text"))
    return F.to_json(F.transform(_col(spans), one))


def write_redacted(docs: DataFrame, path: str, text_col: str = "redacted") -> None:
    """A line of text for each row, an empty one for a null; line breaks in a text stay as they are."""
    docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("value")).write.text(path)


def write_predictions(docs: DataFrame, path: str, text_col: str = "text", spans_col: str = "spans") -> None:
    """Span JSONL: text and spans of start, end and label."""
    keep = F.transform(_col(spans_col), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    docs.select(F.col(text_col).alias("text"), keep.alias("spans")).write.json(path)


def summary(spark: SparkSession, info: dict) -> DataFrame:
    """(key, value) of a model's summary."""
    return spark.createDataFrame([(k, str(v)) for k, v in info.items()], "key string, value string")


def head_labels(labelled: DataFrame, n: int = 32, id_col: str = "doc_id") -> DataFrame:
    """The first n tokens' labels of each document."""
    return labelled.filter(F.col("tok_pos") < n)


def trace(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", tokens_col: str = "n_tokens") -> DataFrame:
    """document, n_tokens and entities (type, start, end, text, score), offsets in code points as they come."""
    one = lambda s: F.struct(s["label"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), cut(text_col, s["start"], s["end"], "chars").alias("text"), s["score"].alias("score"))
    return docs.select(F.col(text_col).alias("document"), F.col(tokens_col).alias("n_tokens"), F.transform(_col(spans_col), one).alias("entities"))


def coalesced_ranges(points: DataFrame, at: str = "cp", value: str = "mask") -> DataFrame:
    """(lo, hi, value) of runs of neighbouring points with one value: gaps and islands.

    Points are a bounded table (code points), so their one window is too.
    """
    w = Window.orderBy(at)
    new = (F.col(at) != F.lag(at).over(w) + 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return points.withColumn("_n", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w)).groupBy("_n", value).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).select("lo", "hi", value)
