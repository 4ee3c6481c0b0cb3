"""Words of texts in scripts with and without spaces."""

import sys
import unicodedata

from pyspark.sql import functions as F

from spanloom.operators import datasets


def test_all_characters_of_scripts_without_spaces_lie_in_the_range(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    alone = "[" + "".join(rf"\p{{Is{x}}}" for x in datasets.UNSPACED) + "]"
    df = spark.createDataFrame([(chr(c),) for c in points], "t string")
    assert df.filter(F.col("t").rlike(alone) & ~F.col("t").rlike(datasets.UNSPACED_FROM)).count() == 0


def test_words_of_a_pair_are_worked_out_once(spark):
    """The words of a text were split again for each of an item's 4,000 passages."""
    import time

    item = " ".join(f"w{k}" for k in range(4_000))
    docs = spark.createDataFrame([(k, f"{'y ' * 20_000}{' '.join(f'w{i}' for i in range(3_980, 3_993))}") for k in range(4)], "doc_id long, text string").coalesce(1)
    began = time.time()
    assert datasets.passages(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 4
    assert time.time() - began < 25
