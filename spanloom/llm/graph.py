"""Connected components of large graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import by_size, discard, materialise


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of undirected edges (a, b); root is the component's least node.

    Alternates large-star and small-star rounds until nothing changes; each
    round is written to the shared folder, and the one before it removed.  A
    node of very many edges is never gathered: its least neighbour is a
    partial aggregate.  No edges give no nodes.
    """

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def with_least(e):
        return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")

    e = materialise(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a <> b").distinct(), "edges")
    old = state(e)
    for _ in range(most_rounds if old[0] else 0):
        both = e.union(e.selectExpr("b AS a", "a AS b"))
        large = with_least(both).filter("b > a").selectExpr("b AS a", "least(a, m) AS b").filter("a <> b").distinct()
        small = with_least(large).selectExpr("explode(array(named_struct('a', a, 'b', m), named_struct('a', b, 'b', m))) AS s").selectExpr("s.a", "s.b").filter("a <> b").distinct()
        e, before = materialise(small, "edges"), e
        new = state(e)
        discard(before)
        if new == old:
            break
        old = new
    else:
        if old[0]:
            raise RuntimeError("components did not settle")
    return e.selectExpr("a AS node", "b AS root").union(e.selectExpr("b AS node", "b AS root").distinct())


def linked(found: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, links, least) of each class that isn't alone: the other documents that each of its documents is linked to, and the least id of its group.

    ``found`` are (c, links, root): links found for a class at one place, and
    some class that they connect it with; ``nodes`` are the distinct (id, c),
    ``classes`` (c, first, copies) each class's least id and number of ids.
    An id of several classes connects them.
    """
    found = materialise(found, "links")
    twice = nodes.groupBy("id").agg(F.min("c").alias("b"), F.count("*").alias("many")).filter("many > 1")
    joint = nodes.join(twice, "id").filter("c <> b").select(F.col("c").alias("a"), "b")
    groups = components(found.selectExpr("c AS a", "root AS b").unionByName(joint)).withColumnRenamed("node", "c").join(classes.select("c", "first"), "c")
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    out = groups.join(least, "root").select("c", "least").join(links, "c", "left").join(classes.filter("copies > 1"), "c", "full")
    out = materialise(out.selectExpr("c", "coalesce(links, 0) + coalesce(copies - 1, 0) AS links", "coalesce(least, first) AS least"), "linked")
    discard(found)
    return out


def by_document(linked: DataFrame, nodes: DataFrame, bare: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of every node; ``bare`` are the ids of rows that have no class, which are linked to nothing."""
    out = nodes.join(by_size(linked, linked.count()), "c", "left").selectExpr("id", "coalesce(least, id) AS class_id", "coalesce(links, 0) AS n_links")
    own = bare.distinct().join(out.groupBy("id").agg(F.min("class_id").alias("least")), "id", "left").selectExpr("id", "coalesce(least, id) AS class_id", "0L AS n_links")
    return out.unionByName(own)


def least_rows(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's group under links (a, b), in memory."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, old):
            return root
