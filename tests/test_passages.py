"""Documents that hold passages of held-out texts."""

from oracle import SF, connect

from spanloom.operators import datasets
from spanloom.plans.queries import QUERIES

ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen, fifteen."


def test_planted_passages_are_found(spark):
    docs = [
        (1, f"before {ITEM} behind"), (2, ITEM), (3, "x " + ITEM[4:].upper()), (4, " ".join(ITEM.split()[:12])),
        (5, "他说。北京是中国的首都。然后"), (6, "a short one, here"), (7, None), (8, ""), (9, "a very short item"),
    ]
    items = [(10, ITEM), (11, "北京是中国的首都。"), (12, "Short one"), (13, "..."), (14, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in datasets.passages(d, b).collect()}
    assert got == {(1, 10, True), (2, 10, True), (3, 10, False), (5, 11, True), (6, 12, False)}
    assert sorted(r.doc_id for r in datasets.without_passages(d, b).collect()) == [4, 7, 8, 9]
    assert datasets.passages(d, b.limit(0)).collect() == [] and datasets.without_passages(d, b.limit(0)).count() == len(docs)


def test_all_that_hold_a_whole_item(spark):
    want = connect().execute("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()
    got = QUERIES["benchmark_passages"](spark, SF).filter("whole").select("doc_id", "item_id").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_copies_are_named(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (6, ""), (7, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n) for r in datasets.repeated_ids(df).collect()) == [(1, 2), (3, 2), (6, 2), (7, 2)]
