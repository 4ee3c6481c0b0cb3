"""Mixing sources to target weights that change over training.

Each source has a weight schedule over training time 0..1, straight between
its knots.  Its cumulative demand of tokens is the integral of the schedule
times the tokens of the run.  A document that begins after c tokens of its
source in the source's own random order is read when the demand reaches c, so
its training position is the inverse of the demand at c.  A source whose
supply is short is read again, epoch after epoch; what the demand doesn't
reach is left out.  Sorting by position range gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import by_size, materialise

#: A source's share of tokens is raised to these powers at the start and the
#: end of training, then made to sum to 1: from the corpus as it is to a flatter mix.
START_POWER, END_POWER = 1.0, 0.5
#: Ranks are found in buckets, by the leading hexadecimal digits of a document's order; a source has as many
#: digits as keep its buckets at about so many tokens.
BUCKET_TOKENS, MOST_DIGITS = 1 << 22, 8
#: Bytes of text aimed at in a range of positions.
RANGE_BYTES = 64 << 20


def power_schedules(supply: dict[str, int], start: float = START_POWER, end: float = END_POWER) -> dict[str, list[tuple[float, float]]]:
    """Schedules of two knots from each source's tokens."""
    total = sum(supply.values())
    if not total:
        return {}
    out = {}
    norm = [sum((n / total) ** p for n in supply.values() if n) for p in (start, end)]
    for k, n in supply.items():
        out[k] = [(float(t), (n / total) ** p / z if n else 0.0) for t, p, z in zip((0, 1), (start, end), norm)]
    return out


def pieces(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(from, to, demand before, weight at its start, slope) of each stretch, demand as a share of the run."""
    knots, out, before = sorted(schedule), [], 0.0
    if not knots or knots[0][0] > 0:
        knots = [(0.0, knots[0][1] if knots else 0.0), *knots]
    if knots[-1][0] < 1:
        knots.append((1.0, knots[-1][1]))
    for (a, u), (b, v) in zip(knots[:-1], knots[1:]):
        if b > a:
            out.append((a, b, before, u, (v - u) / (b - a)))
            before += (b - a) * (u + v) / 2
    return out


def tokens_of(text: str) -> Column:
    """A document's weight where its tokens aren't counted: a token for every four bytes, rounded up; 0 for a null text."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(4)), F.lit(0)).cast("long")


def _stretches(supply: DataFrame, total: int, schedules: dict[str, list[tuple[float, float]]] | None, run: int) -> DataFrame:
    """(_s, _supply, _demand, _parts) of each source that is read: its demand in tokens, and the stretches of its schedule."""
    kind = "array<struct<a: double, d: double, w: double, m: double>>"
    if schedules is not None:
        rows = []
        for k, schedule in schedules.items():
            parts = pieces(schedule)
            a, b, d, w, m = parts[-1]
            rows.append((k, (d + (b - a) * (w + w + m * (b - a)) / 2) * run, [(a, d * run, w * run, m * run) for a, b, d, w, m in parts]))
        given = supply.sparkSession.createDataFrame(rows, f"_s string, _demand double, _parts {kind}")
        return supply.filter("_supply > 0").join(F.broadcast(given), "_s")
    # by the corpus's own shares: worked out where the sources are, however many
    share = supply.filter("_supply > 0").withColumn("_x", F.col("_supply") / F.lit(float(total or 1)))
    z = share.agg(F.sum(F.pow("_x", F.lit(START_POWER))).alias("u"), F.sum(F.pow("_x", F.lit(END_POWER))).alias("v")).first()
    u, v = f"pow(_x, {START_POWER}D) / {z.u or 1.0!r}D", f"pow(_x, {END_POWER}D) / {z.v or 1.0!r}D"
    parts = f"array(named_struct('a', 0D, 'd', 0D, 'w', {u} * {run}D, 'm', ({v} - {u}) * {run}D))"
    return share.selectExpr("_s", "_supply", f"({u} + {v}) / 2 * {run}D AS _demand", f"{parts} AS _parts")


def mix_sources(docs: DataFrame, schedules: dict[str, list[tuple[float, float]]] | None = None, run_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sort: bool = True, position_col: str = "position", epoch_col: str = "epoch", tokens_col: str | None = None, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``docs`` in training order, with its columns and two more: the position in [0, 1) and the epoch from 0.

    A document weighs its ``tokens_col``, or where that isn't given an estimate
    by its bytes, which is off by more in one language than in another.
    ``run_tokens`` is by default all tokens of the corpus; ``schedules`` by
    default goes from the sources' own shares to flatter ones, and a source
    that it doesn't name has no weight.  A null source counts as the source ''.
    Documents without tokens are read with the next one, so they stay where
    that one does.  Equal orders (repeated ids) go by the row's hash; equal
    rows are alike.  A document appears once for each epoch that reaches it.
    Columns of ``docs`` named like the two new ones are replaced, names of any
    other kind are kept.  An empty table gives an empty result.
    """
    base = docs.drop(position_col, epoch_col)
    names = base.columns
    weight = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else tokens_of(text_col)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # the table's own columns travel in one, so that none of their names can clash
    keyed = base.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), source.alias("_s"), order.alias("_o"), weight.alias("_n"))
    supply = materialise(keyed.groupBy("_s").agg(F.sum("_n").alias("_supply")), "supply")
    sums = supply.agg(F.sum("_supply").alias("all"), F.count("*").alias("sources")).first()
    total, run = sums["all"] or 0, float((sums["all"] or 0) if run_tokens is None else run_tokens)
    digits = F.least(F.greatest(F.ceil(F.log(16.0, F.greatest(F.col("_supply") / bucket_tokens, F.lit(1.0)))), F.lit(0)), F.lit(MOST_DIGITS)).cast("int")
    plan = _stretches(supply, total, schedules, run).withColumn("_digits", digits)
    plan = by_size(materialise(plan, "plan"), sums["sources"])
    bucket = F.expr("substring(_o, 1, _digits)")
    light = keyed.select("_s", "_o", "_n")
    buckets = light.join(plan.select("_s", "_digits"), "_s").groupBy("_s", bucket.alias("_b")).agg(F.sum("_n").alias("_t"))
    # a rank within a source is its buckets' tokens before, then a rank in the bucket
    before = materialise(buckets.withColumn("_before", F.sum("_t").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_t")), "buckets")
    w = Window.partitionBy("_s", "_b").orderBy("_o", F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, -1)
    # the join and the rank share one shuffle by source and bucket
    placed = keyed.join(plan, "_s").withColumn("_b", bucket).join(before.select("_s", "_b", "_before"), ["_s", "_b"])
    ranked = placed.withColumn("_c", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    reached = ranked.filter("_c < _demand").withColumn("_k", F.expr("explode(sequence(0L, greatest(0L, CAST(ceil((_demand - _c) / _supply) AS BIGINT) - 1)))")).withColumn("_v", F.expr("_c + _k * _supply")).filter("_v < _demand")
    # weight w + m x integrates to w x + m x^2 / 2 = v - d; its root in a form that doesn't cancel
    found = reached.withColumn("_p", F.expr("element_at(filter(_parts, q -> q.d <= _v), -1)"))
    position = F.expr("least(_p.a + coalesce(2 * (_v - _p.d) / nullif(_p.w + sqrt(greatest(_p.w * _p.w + 2 * _p.m * (_v - _p.d), 0D)), 0D), 0D), 1D)")
    out = found.select("_row.*", position.alias(position_col), F.col("_k").cast("long").alias(epoch_col))
    if not sort:
        return out
    # tokens lie evenly over positions, so the bounds of the ranges are known without sampling
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 4 / RANGE_BYTES))
    part = F.least(F.floor(F.col(position_col) * parts), F.lit(parts - 1)).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions(position_col, epoch_col, id_col)
