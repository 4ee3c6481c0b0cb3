"""Windows over long token sequences: each is read with a halo on both sides, of which only the inner part counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.offsets import _col

WINDOW = 4096


def halo_of(layers: int, radius: int) -> int:
    """How far a token sees through so many layers."""
    return layers * radius


def windows(n, window: int = WINDOW, halo: int = 1024) -> Column:
    """Array of (start, wlen, lo, hi) for n tokens; tokens start+lo .. start+hi-1 are the window's own.

    Up to ``window`` tokens are one window.  Where more must be cut and the
    window isn't wider than two halos, the row fails.
    """
    n = _col(n).cast("int")
    one = F.array(F.struct(F.lit(0).alias("start"), n.alias("wlen"), F.lit(0).alias("lo"), n.alias("hi")))
    if window <= 2 * halo:
        return F.when(n <= window, one).when(n > window, F.raise_error(F.concat(n.cast("string"), F.lit(f" tokens need a window of more than {2 * halo}"))))
    stride = window - 2 * halo
    last = F.ceil((n - window) / F.lit(stride)).cast("int")

    def at(k):
        start, wlen = k * stride, F.least(F.lit(window), n - k * stride)
        end = start + wlen >= n
        return F.struct(start.alias("start"), wlen.alias("wlen"), F.when(k == 0, 0).otherwise(halo).alias("lo"), F.when(end, wlen).otherwise(wlen - halo).alias("hi"))

    return F.when(n <= window, one).when(n > window, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at))


def explode_windows(tokens: DataFrame, ids_col: str = "ids", window: int = WINDOW, halo: int = 1024) -> DataFrame:
    """A row for each window of each row of ``tokens``: its columns but the ids, win (the window) and win_ids.

    Windows don't depend on each other, so one document's may run in several tasks.
    """
    rest = [c for c in tokens.columns if c != ids_col]
    cut = tokens.withColumn("win", F.explode(windows(F.size(ids_col), window, halo)))
    return cut.select(*rest, "win", F.slice(ids_col, F.col("win.start") + 1, F.col("win.wlen")).alias("win_ids"))


def stitch(done: DataFrame, rows_col: str = "rows", out_col: str = "value") -> DataFrame:
    """A row for each token a window owns: columns of ``done`` but win and its rows, tok_pos and the token's row.

    Every token comes once, so nothing is deduplicated or shuffled.
    """
    rest = [c for c in done.columns if c not in ("win", rows_col, "win_ids")]
    own = F.slice(rows_col, F.col("win.lo") + 1, F.col("win.hi") - F.col("win.lo"))
    return done.select(*rest, (F.col("win.start") + F.col("win.lo")).alias("_first"), F.posexplode(own).alias("_k", out_col)).select(*rest, (F.col("_first") + F.col("_k")).alias("tok_pos"), out_col)


def log_softmax(logits) -> Column:
    """Log-probabilities of an array of logits, summed in double."""
    x = _col(logits)
    top = F.array_max(x).cast("double")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
    shifted = F.log(total)
    return F.transform(x, lambda v: (v.cast("double") - top - shifted).cast("double"))


def argmax(values) -> Column:
    """The least index of the greatest value, from 0."""
    return (F.array_position(_col(values), F.array_max(_col(values))) - 1).cast("int")
