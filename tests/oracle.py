"""Spark results and DuckDB results side by side."""

import os
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder=SF):
    con = duckdb.connect()
    for p in os.listdir(folder):
        path = f"{folder}/{p}/*.parquet" if os.path.isdir(f"{folder}/{p}") else f"{folder}/{p}"
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql, folder=SF):
    ours, theirs = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
