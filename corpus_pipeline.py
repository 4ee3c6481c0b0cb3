"""The corpus pipeline: toxicity, near duplicates, private data, mixing, packing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns what the next one takes as docs.  ``run`` applies them to documents,
each stage's result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, ngramjoin, packing, pii, tokencount, toxicity
from spanloom.llm.store import bounded_batches, free_name, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is trained on labelled documents of ``docs``.

    Rows of a null or an empty text stay, a score equal to its threshold isn't
    toxic, repeated rows are judged each.
    Without labels of both kinds nothing goes.  All columns stay, whatever
    their names.  An empty table stays empty.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays.

    Rows of a null id or text, and texts without a word, stay.  Rows of one id
    stay or go together, repeated ones included, so ties don't arise.  All
    columns stay.  An empty table stays empty.
    """
    bounded_batches(spark)
    return ngramjoin.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private spans are replaced in the text; n_chars follows.

    Null and empty texts stay as they are (n_chars is then null and 0);
    repeated rows are redacted alike.  All other columns stay as they are.  An
    empty table stays empty.
    """
    bounded_batches(spark)
    return pii.redact_column(docs, pii.fit())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, repeated or left out as their source's weight asks, weighed by their tokens.

    A null source counts as the source ''.  Texts without tokens are read with
    the next one of their source.  Repeated rows are read each.  Equal orders
    go by the row's hash.  All columns stay.  An empty table stays empty.
    """
    bounded_batches(spark)
    tokens = free_name(docs, "n_tokens")
    counted = materialise(tokencount.with_tokens(docs, tokens), "counted")  # written, as it is read three times
    return mixing.mix_sources(counted, tokens_col=tokens, position_col=free_name(counted, "position"), epoch_col=free_name(counted, "epoch")).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among the training windows.

    Documents without tokens, of a null or an empty text, have no piece.
    Repeated rows are packed each, a null id is kept, columns but id and text
    aren't read.  An empty table gives an empty result.
    """
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("private", redact_private), ("mixing", mix), ("packing", pack)]

#: A trained network and best-fit packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
