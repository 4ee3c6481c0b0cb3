"""Queries that tokenize and clean up turns do so with whole documents too."""

import pytest
from oracle import SF

from spanloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["trim_spans", "merge_near_spans", "pretoken_spans", "bioes_encode", "wrapped_lines", "tokenize_bpe", "classify_by_model"])
def test_registered_over_documents(spark, name):
    assert QUERIES[f"{name}_documents"](spark, SF).columns[0] == "doc_id"


def test_tokens_reach_the_ends_of_documents(spark):
    from pyspark.sql import functions as F

    ends = QUERIES["tokenize_bpe_documents"](spark, SF).groupBy("doc_id").agg(F.min("start"), F.max("end")).collect()
    sizes = spark.read.parquet(f"{SF}/documents.parquet").filter("text <> ''").selectExpr("doc_id", "0", "octet_length(text)").collect()
    assert sorted(map(tuple, ends)) == sorted(map(tuple, sizes))
