"""Scoring of predicted spans against true ones, by exact match.

Rows are joined once, by their number; all set logic then stays in the row,
and what is shuffled after that are partial counts by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,label:string>>"


def align(gold: DataFrame, pred: DataFrame, key: str = "row_no") -> DataFrame:
    """(key, gold, pred) span sets of aligned rows; fails on a row that only one side has, or of another text."""
    # a text is compared by its digest, so that no text is shuffled
    g = gold.select(key, F.sha2("text", 256).alias("_gt"), F.col("spans").cast(SPANS).alias("gold"), F.lit(True).alias("_g"))
    p = pred.select(key, F.sha2("text", 256).alias("_pt"), F.col("spans").cast(SPANS).alias("pred"), F.lit(True).alias("_p"))
    both = g.join(p, key, "full_outer")
    error = F.when(F.col("_g").isNull() | F.col("_p").isNull(), "only one side has row ").when(~F.col("_gt").eqNullSafe(F.col("_pt")), "texts differ in row ")
    none = F.array().cast(SPANS)
    checked = F.when(error.isNotNull(), F.raise_error(F.concat(error, F.col(key).cast("string"))).cast(SPANS)).otherwise(F.coalesce("gold", none))
    return both.select(key, F.array_distinct(checked).alias("gold"), F.array_distinct(F.coalesce("pred", none)).alias("pred"))


def matched(pairs: DataFrame) -> DataFrame:
    """``pairs`` with tp, fn, fp and partial: missed spans that a false one of their label overlaps."""

    def overlaps(a: Column, b: Column) -> Column:
        return (a["label"] == b["label"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])

    sets = pairs.withColumn("tp", F.array_intersect("gold", "pred")).withColumn("fn", F.array_except("gold", "pred")).withColumn("fp", F.array_except("pred", "gold"))
    return sets.withColumn("partial", F.filter("fn", lambda a: F.exists(F.col("fp"), lambda b: overlaps(a, b))))


def ratios(tp, fp, fn) -> list[Column]:
    """Precision, recall and F1; 0 where there is nothing to divide by."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1")]


def counts(gold: DataFrame, pred: DataFrame, key: str = "row_no") -> DataFrame:
    """(label, tp, fp, fn, partial) of every label that either side has."""
    rows = matched(align(gold, pred, key))
    kinds = ("tp", "fp", "fn", "partial")

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["label"].alias("label"), F.lit(kind).alias("kind")))

    one = rows.select(F.explode(F.concat(*map(tagged, kinds))).alias("x")).select("x.label", "x.kind")
    return one.groupBy("label").agg(*(F.count_if(F.col("kind") == F.lit(k)).alias(k) for k in kinds))


def score(gold: DataFrame, pred: DataFrame, key: str = "row_no") -> DataFrame:
    """(label, tp, fp, fn, partial, precision, recall, f1) by label."""
    c = counts(gold, pred, key)
    return c.select("label", "tp", "fp", "fn", "partial", *ratios("tp", "fp", "fn"))


def report(gold: DataFrame, pred: DataFrame, key: str = "row_no") -> DataFrame:
    """The scores by label, then two rows of totals: 'micro' with their ratios, 'macro' with the labels' mean ratios.

    The labels are a bounded set, so all is read once: their rows meet in one
    row, which is taken apart again.
    """
    names = ("label", "tp", "fp", "fn", "partial", "precision", "recall", "f1")
    whole = score(gold, pred, key).agg(F.collect_list(F.struct(*names)).alias("by"))
    total = lambda k: F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x[k])
    mean = lambda k: F.coalesce(F.aggregate("by", F.lit(0.0), lambda a, x: a + x[k]) / F.nullif(F.size("by"), F.lit(0)), F.lit(0.0))
    summed = whole.select("by", *(total(k).alias(k) for k in names[1:5]))
    four = [F.col(k) for k in names[1:5]]
    micro = F.struct(F.lit("micro").alias("label"), *four, *ratios("tp", "fp", "fn"))
    macro = F.struct(F.lit("macro").alias("label"), *four, *(mean(k).alias(k) for k in names[5:]))
    return summed.select(F.explode(F.concat("by", F.array(micro, macro))).alias("x")).select("x.*")


def row_parity(rows: DataFrame, ref: str = "ref", got: str = "got", margin: float = 1e-3) -> DataFrame:
    """``rows`` with cosine, row_err (greatest difference over the reference's greatest value), same_argmax and tie.

    A row whose best class differs is a tie where the reference's two best are within ``margin``.
    """
    from spanloom.operators.windows import argmax

    r, g = F.col(ref), F.col(got)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    top = F.array_max(F.transform(r, F.abs)).cast("double")
    diff = F.array_max(F.zip_with(r, g, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    by_size = F.reverse(F.array_sort(r))
    return rows.withColumns({
        "cosine": dot(r, g) / F.nullif(F.sqrt(dot(r, r)) * F.sqrt(dot(g, g)), F.lit(0.0)),
        "row_err": diff / F.nullif(top, F.lit(0.0)),
        "same_argmax": argmax(ref) == argmax(got),
        "tie": (argmax(ref) != argmax(got)) & (by_size[0] - by_size[1] <= margin),
    })


def tap_differences(ref: DataFrame, got: DataFrame, margin: float = 1e-3) -> DataFrame:
    """(tap, place, rows, max_diff, differing_sets, ties) of taps (tap, row, val array), in the order in which they are made.

    A tap of chosen experts (``..topk``) is compared as a set, row by row.
    A row whose sets differ is a tie, and no difference, where the reference's
    logits of that layer (``..logits`` of the same prefix) part what was chosen
    from what wasn't by ``margin`` or less.  max_diff is that of other taps.
    """
    a, b = ref.select("tap", "row", F.col("val").alias("a")), got.select("tap", "row", F.col("val").alias("b"))
    chosen = F.col("tap").endswith("topk")
    logits = ref.filter(F.col("tap").endswith("moe_logits")).select(F.regexp_replace("tap", "moe_logits$", "moe_topk").alias("tap"), "row", F.col("val").alias("logits"))
    both = a.join(b, ["tap", "row"]).join(logits, ["tap", "row"], "left")
    k = F.size("a")
    sorted_down = F.reverse(F.array_sort("logits"))
    close = F.coalesce(F.try_element_at(sorted_down, k) - F.try_element_at(sorted_down, k + 1) <= margin, F.lit(False))
    apart = chosen & ((F.size(F.array_except("a", "b")) > 0) | (F.size(F.array_except("b", "a")) > 0))
    diff = F.when(~chosen, F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))))
    found = both.groupBy("tap").agg(F.count("*").alias("rows"), F.coalesce(F.max(diff), F.lit(0.0)).alias("max_diff"), F.count_if(apart & ~close).alias("differing_sets"), F.count_if(apart & close).alias("ties"))
    return found.withColumn("place", tap_place("tap")).select("tap", "place", "rows", "max_diff", "differing_sets", "ties")


#: Steps within a layer, in the order in which they are made.
LAYER_TAPS = ("attn_norm", "q_rope", "k_rope", "attn_out", "ffn_inp", "post_norm", "moe_logits", "moe_topk", "moe_weights", "moe_out", "l_out")


def tap_place(tap) -> Column:
    """Where a tap comes in a forward pass, from its name alone: the embedding, layer after layer, the result, the logits."""
    name = F.col(tap) if isinstance(tap, str) else tap
    layer = F.regexp_extract(name, r"^l([0-9]+)\.", 1)
    step = F.array_position(F.array(*map(F.lit, LAYER_TAPS)), F.regexp_extract(name, r"^l[0-9]+\.(.*)$", 1))
    return F.when(name == "embd", 0).when(name == "result_norm", (1 << 30) - 1).when(name == "logits", 1 << 30).when(layer != "", layer.try_cast("int") * 100 + step).cast("int")


def first_divergence(ref: DataFrame, got: DataFrame, order: list[str] | None = None, limit: float = 1e-3) -> DataFrame:
    """(tap, ordinal, max_diff) of the first tap whose values (tap, row, val array) differ by more, or whose choices differ but for ties.

    First in ``order``, or where none is given in that of a forward pass.
    """
    found = tap_differences(ref, got, limit)
    place = F.col("place") if order is None else F.array_position(F.array(*map(F.lit, order)), F.col("tap")).cast("int")
    first = found.withColumn("ordinal", place).filter((F.col("max_diff") > limit) | (F.col("differing_sets") > 0))
    return first.filter(F.col("ordinal") >= (0 if order is None else 1)).orderBy("ordinal").limit(1).select("tap", "ordinal", "max_diff")


def token_mismatches(ours: DataFrame, theirs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose token ids or offsets differ between two tokenisations (id, ids, starts, ends)."""
    cols = ("ids", "starts", "ends")
    a, b = (d.select(id_col, *(F.col(c).alias(f"{p}_{c}") for c in cols)) for d, p in ((ours, "a"), (theirs, "b")))
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, id_col, "full_outer").filter(differs)


def minimised(text: str, fails) -> str:
    """A shortest text found by cutting pieces out of ``text`` for which ``fails`` still holds."""
    step = max(1, len(text) // 2)
    while step:
        at, cut = 0, False
        while at < len(text):
            less = text[:at] + text[at + step :]
            if fails(less):
                text, cut = less, True
            else:
                at += step
        step = step if cut and step > 1 else step // 2
    return text


def category_counts(entities: DataFrame, label_col: str = "label", top: int | None = None) -> DataFrame:
    """(label, n) by falling count, then label."""
    found = entities.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return found if top is None else found.limit(top)
