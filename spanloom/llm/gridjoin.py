"""Near duplicates among embeddings by an epsilon grid order join.

Vectors are turned onto their principal dimensions, laid in cells of side
epsilon on the leading ones, and sorted by cell, dimension after dimension.
Two sequences of that order are joined by halving: a pair of intervals whose
bounding boxes are farther apart than epsilon is skipped, and small intervals
are compared by one matrix product.  The join is exact.

Across executors the sorted sequence is cut into ranges, and ranges are joined
by the same recursion from the whole sequence down: intervals of FAN ranges,
of FAN such intervals, and so on, of which only near ones are gone into.  Pairs
of ranges that are near are tasks.  Equal vectors are joined once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B
from spanloom.llm.graph import by_document, least_rows, linked
from spanloom.llm.store import materialise

EPSILON = 0.25
#: Leading dimensions that order the cells, and those that boxes are measured on.
CELL_DIMS, BOX_DIMS = 8, 16
#: Vectors aimed at in a range of the sequence; and in an interval that is compared whole.
RANGE_ROWS, LEAF = 8192, 256
#: Ranges of an interval, and intervals of the next larger one.
FAN = 32


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _moments(dim: int):
    """Sums for mean and covariance: of vectors, or of such sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            if len(x):
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        yield _row(n, total, square)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(b)
                n, total, square = n + k, total + x[:dim], square + x[dim:].reshape(dim, dim)
        yield _row(n, total, square)

    def _row(n, total, square):
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([total, square.ravel()]).tobytes()])], ["n", "sums"])

    return of, merged


def principal(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) over all vectors; columns of the rotation by falling variance."""
    of, merged = _moments(dim)
    sums = vectors.select("v").mapInArrow(of, "n long, sums binary").repartition(16).mapInArrow(merged, "n long, sums binary").toPandas()
    n = int(sums.n.sum())
    x = sum(np.frombuffer(b) for b in sums.sums)
    mean = x[:dim] / max(n, 1)
    cov = x[dim:].reshape(dim, dim) / max(n, 1) - np.outer(mean, mean)
    return mean, np.linalg.eigh(cov)[1][:, ::-1]


def near_intervals(x: np.ndarray, y: np.ndarray, eps: float, same: bool, leaf: int = LEAF) -> Iterator[tuple[slice, slice]]:
    """Pairs of intervals of two sequences that must be compared; of one sequence with itself each pair once."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and c < a):
            continue
        gap = np.maximum(0, np.maximum(x[a:b].min(axis=0) - y[c:d].max(axis=0), y[c:d].min(axis=0) - x[a:b].max(axis=0)))
        if float(gap @ gap) > eps * eps * (1 + 1e-9):
            continue
        if b - a <= leaf and d - c <= leaf:
            yield slice(a, b), slice(c, d)
        elif same and a == c and b == d:
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def join_sequences(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) within eps; rx and ry are the rotated leading dimensions."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    nx, ny = (x32 * x32).sum(axis=1), (y32 * y32).sum(axis=1)
    slack = 1e-4 * float(max(1, nx.max(initial=0), ny.max(initial=0)))
    for s, t in near_intervals(rx, ry, eps, same):
        near = nx[s, None] + ny[None, t] - 2 * (x32[s] @ y32[t].T) <= eps * eps + slack
        if same and s == t:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = i + s.start, j + t.start
        for a in range(0, len(i), 1 << 15):
            p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            dist = np.sqrt(((x[p] - y[q]) ** 2).sum(axis=1))
            ok = dist <= eps
            if ok.any():
                yield p[ok], q[ok], dist[ok]


class Join:
    """The join over ``vectors``: ``nodes`` (id, c) are the distinct pairs of an id and a vector, ``classes`` (c, first, copies) the vectors."""

    def __init__(self, vectors: DataFrame, epsilon: float, id_col: str, vector_col: str, range_rows: int, fan: int):
        self.epsilon, self.range_rows, self.fan = epsilon, range_rows, fan
        self.kind = vectors.schema[id_col].dataType.simpleString()
        # single precision stays so until it is worked with: vectors are most of what is shuffled
        self.inner = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
        v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{self.inner}>").alias("v")).filter("id IS NOT NULL")
        good = "coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), false)"
        self.bare = v.filter(f"NOT {good}").select("id")
        # vectors are told apart by 64 bits; zeros of either sign are equal
        v = v.filter(good).withColumn("v", F.expr(f"transform(v, x -> CAST(x + 0 AS {self.inner}))")).withColumn("c", F.xxhash64("v"))
        self.nodes = materialise(v.select("id", "c").distinct(), "nodes")
        self.classes = materialise(self.nodes.groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
        one = self.classes.select("c", F.col("first").alias("id"), "copies")
        self.distinct = v.join(one, ["c", "id"]).dropDuplicates(["c"]).select("c", "copies", "v")

    def _joined(self, listed: bool) -> DataFrame:
        schema = "a long, b long, distance double" if listed else "c long, links long, root long"
        each = materialise(self.distinct, "vectors")
        lengths = sorted((r["dim"], r["count"]) for r in each.groupBy(F.size("v").alias("dim")).count().collect())
        # a length that one vector has makes no pair
        found = [self._of_length(each.filter(f"size(v) = {dim}"), n, dim, listed, schema) for dim, n in lengths if n > 1]
        return functools.reduce(DataFrame.unionAll, found) if found else each.sparkSession.createDataFrame([], schema)

    def _of_length(self, v: DataFrame, n: int, dim: int, listed: bool, schema: str) -> DataFrame:
        epsilon, fan = self.epsilon, self.fan
        mean, turn = principal(v, dim)
        box = min(BOX_DIMS, dim)
        turn = turn[:, :box]
        cells = min(CELL_DIMS, dim)

        def turned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r = (x - mean) @ turn
            return r, np.floor(r[:, :cells] / epsilon).clip(-(2**62), 2**62).astype(np.int64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    r, c = turned(_matrix(batch.column(2)).astype(np.float64))
                    lists = pa.ListArray.from_arrays(np.arange(0, r.size + 1, box, dtype=np.int32), r.ravel())
                    cell = pa.ListArray.from_arrays(np.arange(0, c.size + 1, cells, dtype=np.int32), c.ravel())
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists, cell], ["c", "copies", "v", "turned", "cell"])

        placed = v.mapInArrow(place, f"c long, copies long, v array<{self.inner}>, turned array<double>, cell array<long>")
        ranges = max(1, -(-n // self.range_rows))
        order = [F.col("cell")[k] for k in range(cells)]
        laid = materialise(placed.repartitionByRange(ranges, *order, "c").withColumn("part", F.spark_partition_id()), "laid")
        low = [F.min(F.col("turned")[k]).alias(f"l{k}") for k in range(box)]
        high = [F.max(F.col("turned")[k]).alias(f"h{k}") for k in range(box)]
        boxes = [materialise(laid.groupBy("part").agg(*low, *high), "boxes")]
        width = 1
        while width < ranges:
            width *= fan
            up = [F.min(f"l{k}").alias(f"l{k}") for k in range(box)] + [F.max(f"h{k}").alias(f"h{k}") for k in range(box)]
            boxes.append(materialise(boxes[-1].groupBy(F.expr(f"CAST(part DIV {fan} AS INT)").alias("part")).agg(*up), "boxes"))

        def sides(level: DataFrame, name: str) -> DataFrame:
            return level.toDF(*(f"{name}_{c}" for c in level.columns))

        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_l{k}") - F.col(f"b_h{k}"), F.col(f"b_l{k}") - F.col(f"a_h{k}")), 2) for k in range(box)), F.lit(0.0))
        near = boxes[-1].selectExpr("part AS a", "part AS b")  # the whole sequence with itself
        for level in boxes[-2::-1]:
            a, b = sides(level, "a").withColumn("a", F.expr(f"CAST(a_part DIV {fan} AS INT)")), sides(level, "b").withColumn("b", F.expr(f"CAST(b_part DIV {fan} AS INT)"))
            near = near.join(a, "a").join(b, "b").filter("a_part <= b_part").filter(gap <= epsilon * epsilon * (1 + 1e-9)).selectExpr("a_part AS a", "b_part AS b")
        tasks = near.selectExpr("concat_ws(' ', a, b) AS task", "explode(array_distinct(array(a, b))) AS part")

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in B.groups(batches, "task"):
                c, copies, part = (t.column(k).to_numpy() for k in ("c", "copies", "part"))
                x = _matrix(t.column("v")).astype(np.float64)
                r, cell = turned(x)
                order = np.lexsort((c, *cell.T[::-1]))
                both = [order[part[order] == p] for p in np.unique(part)]
                s, e = both[0], both[-1]
                links, low, high = np.zeros(len(c), np.int64), [], []
                for i, j, dist in join_sequences(x[s], x[e], r[s], r[e], epsilon, len(both) == 1):
                    p, q = s[i], e[j]
                    if listed:
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[p], c[q])), pa.array(np.maximum(c[p], c[q])), pa.array(dist)], ["a", "b", "distance"])
                        continue
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    # what connects the rows so far is kept, not the pairs
                    low.append(p)
                    high.append(q)
                    if sum(map(len, low)) > 1 << 20:
                        root = least_rows(len(c), np.concatenate(low), np.concatenate(high))
                        low, high = [root], [np.arange(len(c))]
                if low:
                    root = least_rows(len(c), np.concatenate(low), np.concatenate(high))
                    has = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(c[has]), pa.array(links[has]), pa.array(c[root[has]])], ["c", "links", "root"])

        return tasks.join(laid, "part").select("task", "part", "c", "copies", "v").repartition("task").sortWithinPartitions("task").mapInArrow(join, schema)

    def pairs(self) -> DataFrame:
        return self._joined(True)

    def linked(self) -> DataFrame:
        return linked(self._joined(False), self.nodes, self.classes)


def embedding_near_join(vectors: DataFrame, epsilon: float = EPSILON, id_col: str = "vec_id", vector_col: str = "embedding", range_rows: int = RANGE_ROWS, fan: int = FAN) -> DataFrame:
    """(id, class_id, n_links), a row for each vector.

    A vector is linked to every other one at a Euclidean distance of epsilon
    or less, equal ones included; n_links is their number, and class_id the
    least id of all that links connect, the vector's own where there are none.
    Rows of a null id give no row.  A vector that is null, empty or has a null
    or not finite entry is linked to nothing.  Vectors are joined within each
    length.  Repeated rows are one vector; an id with several vectors has a row
    for each (and one for those that are no vectors), linked or not as they
    are, but all of one class.  Other columns aren't read.  An empty table
    gives an empty result.
    """
    join = Join(vectors, epsilon, id_col, vector_col, range_rows, fan)
    return by_document(join.linked(), join.nodes, join.bare).withColumnRenamed("id", id_col)


def embedding_near_pairs(vectors: DataFrame, epsilon: float = EPSILON, id_col: str = "vec_id", vector_col: str = "embedding", range_rows: int = RANGE_ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (c, id) of each distinct vector c, and (a, b, distance) of those within epsilon, a < b.

    Copies aren't expanded into pairs.  Rows of a null id, and of what is no
    vector, are in neither.
    """
    join = Join(vectors, epsilon, id_col, vector_col, range_rows, fan)
    return join.nodes.select("c", F.col("id").alias(id_col)), join.pairs()
