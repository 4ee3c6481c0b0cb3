"""Training data for token classifiers: labels of tokens, checks, splits."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import rows_of
from spanloom.functions.labels import resolve_category
from spanloom.functions.offsets import _col

IGNORED = -100
#: Words in a row that make a passage; a text of fewer words is one passage.
PASSAGE_WORDS = 13
#: Scripts without spaces: each character is a word.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: All characters of those scripts, and others.
UNSPACED_FROM = r"[\x{e00}-\x{10ffff}]"


def classes_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, str]], ids: dict[str, int]) -> np.ndarray:
    """Class of each token of (start, end) under spans (start, end, label).

    Where tokens lie in order, a span's are found by bisection, so the work
    doesn't grow with tokens times spans.
    """
    out = np.where(starts == ends, IGNORED, ids["O"]).astype(np.int32)
    if not spans or not len(out):
        return out
    wide = np.flatnonzero(starts != ends)
    a, b = starts[wide], ends[wide]
    known: dict[str, list[int | None]] = {}
    in_order = bool((a[1:] >= a[:-1]).all() and (b[1:] >= b[:-1]).all())
    if in_order:
        first = np.searchsorted(b, [s for s, _, _ in spans], side="right").tolist()
        past = np.searchsorted(a, [e for _, e, _ in spans], side="left").tolist()
    for i, (s, e, label) in enumerate(spans):
        hit = wide[first[i] : past[i]] if in_order else wide[(a < e) & (s < b)]
        if len(hit) == 0:
            continue
        if label not in known:
            category = resolve_category(label, ids)
            known[label] = [ids.get(f"{tag}-{category}") for tag in "BIES"]
        begin, inner, last, single = known[label]
        if len(hit) == 1:
            if single is not None:
                out[hit[0]] = single
            continue
        if begin is not None:
            out[hit[0]] = begin
        if last is not None:
            out[hit[-1]] = last
        if inner is not None and len(hit) > 2:
            out[hit[1:-1]] = inner
    return out


def bioes_labels(tokens, spans, labels: Sequence[str]) -> Column:
    """Class of each token (start, end) under spans (start, end, label); -100 for a token of no width.

    A token belongs to the last span that overlaps it and whose label for that
    place is known; one of none is O.  Null tokens give null, null spans count
    as none.
    """
    ids = {x: i for i, x in enumerate(labels)}

    @F.arrow_udf("array<int>")
    def run(t: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for own, found in zip(t, s.to_pylist()):
            if not own.is_valid:
                out.append(None)
                continue
            v = own.values
            starts, ends = (v.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
            out.append(classes_of(starts, ends, [(x["start"], x["end"], x["label"]) for x in found or ()], ids))
        return pa.array(out, pa.list_(pa.int32()))

    pair = lambda x, kind: _col(x).cast(f"array<struct<start:int,end:int{kind}>>")
    whole = F.transform(_col(tokens), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    named = F.transform(_col(spans), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label")))
    return run(pair(whole, ""), pair(named, ",label:string"))


def class_rows(rows: DataFrame, keys: tuple[str, ...], words: str, patterns: Sequence[tuple[str, str]], labels: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys, pos, class) of each match of ``words`` in a text under the matches of (label, pattern), as ``bioes_labels`` gives them; offsets are characters.

    The patterns must be such as Java and Python read alike.
    """
    ids, word, found = {x: i for i, x in enumerate(labels)}, re.compile(words), [(label, re.compile(p)) for label, p in patterns]

    def make(texts):
        out = [np.zeros(0, np.int32)]
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            at = np.array([m.span() for m in word.finditer(text)], np.int64).reshape(-1, 2)
            out.append(classes_of(at[:, 0], at[:, 1], [(*m.span(), label) for label, p in found for m in p.finditer(text)], ids))
        counts = np.array([len(x) for x in out[1:]], np.int64)
        places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return counts, [places, np.concatenate(out).astype(np.int64)]

    return rows_of(rows, keys, [_col(text_col).cast("binary")], "pos bigint, class bigint", make)


def faults(rows: DataFrame, labels: Sequence[str], text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``rows`` with bad_offsets, bad_label, overlapping: what a checker of span data would refuse."""
    s, n = F.col(spans_col), F.char_length(text_col)
    ordered = F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    # of spans sorted by start, two overlap only if two neighbours do
    meets = F.exists(F.zip_with(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda b, a: b["start"] < a["end"]), lambda x: x)
    return rows.withColumns({
        "bad_offsets": F.exists(s, lambda x: (x["start"] < 0) | (x["end"] > n) | (x["start"] >= x["end"])),
        "bad_label": F.exists(s, lambda x: ~x["label"].isin(*labels)),
        "overlapping": meets,
    })


def repeated_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, n) of texts that more than one row has; only hashes are shuffled."""
    return rows.filter(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("text_hash")).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_ids(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_hash, n, id) of each row whose text more than one row has; only hashes and ids are shuffled."""
    keyed = rows.filter(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col), 256).alias("text_hash"), F.col(id_col))
    return keyed.select("text_hash", F.count("*").over(Window.partitionBy("text_hash")).alias("n"), id_col).filter("n > 1")


def without(rows: DataFrame, held_out: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` whose text is none of ``held_out``'s."""
    keys = held_out.select(F.sha2(F.col(text_col), 256).alias("_h")).filter("_h IS NOT NULL")
    return rows.withColumn("_h", F.sha2(F.col(text_col), 256)).join(keys, "_h", "left_anti").select(*rows.columns)


def leaked(rows: DataFrame, held_out: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` whose text is one of ``held_out``'s."""
    keys = held_out.select(F.sha2(F.col(text_col), 256).alias("_h")).filter("_h IS NOT NULL")
    return rows.withColumn("_h", F.sha2(F.col(text_col), 256)).join(keys, "_h", "left_semi").select(*rows.columns)


def words(text) -> Column:
    """Lower-case runs of letters, marks, digits and underscores; in a script without spaces each character."""
    alone, low = "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])", F.lower(_col(text))
    # one range is looked for far faster than seven scripts
    apart = F.when(low.rlike(UNSPACED_FROM), F.regexp_replace(low, alone, " $1 ")).otherwise(low)
    return F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def _runs(w: Column, k: Column, each, distinct: bool = True) -> Column:
    """``each`` of every run of k words, without repetitions where ``distinct``; none of fewer words."""
    places = F.when((F.size(w) >= k) & (k > 0), F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(places, lambda i: each(F.slice(w, i, k)))
    return F.array_distinct(found) if distinct else found


def passages(rows: DataFrame, held_out: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = PASSAGE_WORDS) -> DataFrame:
    """(id, item, whole) of each text that holds a passage of a held-out item: ``run`` of its words in a row, or all of a shorter one.

    ``whole`` tells whether the text holds the item's text as it stands.  Case
    and what parts words don't count, otherwise.  Hashes of runs are joined,
    and what they find is verified in the texts.  Nulls of ids or texts, and
    items without words, are in no pair.
    """
    items = held_out.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), F.col(text_col).alias("_passage"), words(text_col).alias("_v"))
    items = items.withColumn("_k", F.least(F.size("_v"), F.lit(run))).filter("_k > 0")
    lengths = sorted(r[0] for r in items.select("_k").distinct().collect())
    keys = items.select("_item", "_k", F.explode(_runs(F.col("_v"), F.col("_k"), F.xxhash64)).alias("_h"))
    texts = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    split = texts.select("_id", words("_text").alias("_w"))
    runs = split.select("_id", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_k"), "_w") if len(lengths) != 1 else split.withColumn("_k", F.lit(lengths[0]))
    hashes = runs.select("_id", "_k", F.explode(_runs(F.col("_w"), F.col("_k"), F.xxhash64, distinct=False)).alias("_h"))
    near = hashes.join(keys, ["_k", "_h"]).select("_id", "_item").distinct()
    met = near.join(items, "_item").join(texts, "_id")
    joined = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    once = F.array(F.struct(joined(words("_text")).alias("all"), _runs(F.col("_v"), F.col("_k"), joined).alias("runs")))  # worked out once, not once a run
    held = F.exists(once, lambda o: F.exists(o["runs"], lambda x: F.contains(o["all"], x)))
    return met.filter(held).select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), F.contains("_text", "_passage").alias("whole")).distinct()


def without_passages(rows: DataFrame, held_out: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = PASSAGE_WORDS) -> DataFrame:
    """``rows`` whose text holds no passage of ``held_out``."""
    return rows.join(passages(rows, held_out, id_col, item_col, text_col, run).select(id_col).distinct(), id_col, "left_anti").select(*rows.columns)


def leaking(rows: DataFrame, held_out: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = PASSAGE_WORDS) -> DataFrame:
    """``rows`` whose text holds a passage of ``held_out``."""
    return rows.join(passages(rows, held_out, id_col, item_col, text_col, run).select(id_col).distinct(), id_col, "left_semi").select(*rows.columns)


#: Leading hexadecimal digits of a row's order in which an exact split counts rows.
SPLIT_DIGITS = 4


def split_order(seed: int, id_col: str) -> Column:
    """The order in which rows are taken for validation: a hash of the seed and the id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def with_exact_split(rows: DataFrame, share: float, seed: int = 0, id_col: str = "row_no", out_col: str = "is_validation") -> DataFrame:
    """``rows`` with a flag on exactly the whole part of share x rows, the first in the order of a seeded hash, then of the id.

    Rows are counted by the leading digits of their order, so only the few
    that share the digits where the share is reached are sorted.  Ids must be
    unique for the count to be exact: rows of one id are flagged alike.
    """
    order = split_order(seed, id_col)
    head = F.substring(order, 1, SPLIT_DIGITS)
    counted = rows.groupBy(head.alias("h")).agg(F.count("*").alias("n")).orderBy("h").collect()  # 16^SPLIT_DIGITS rows at most
    want = int(sum(r.n for r in counted) * share)
    edge, before = None, 0
    for r in counted:
        if before + r.n > want:
            edge = r.h
            break
        before += r.n
    if edge is None:
        return rows.withColumn(out_col, F.lit(bool(want)))
    inner = rows.filter(head == edge).select(F.struct(order.alias("o"), F.col(id_col).alias("i")).alias("k")).orderBy("k").limit(want - before).agg(F.max("k").alias("k")).first().k
    at = F.struct(order, F.col(id_col))
    flag = head < F.lit(edge) if inner is None else (head < F.lit(edge)) | (at <= F.struct(F.lit(inner.o), F.lit(inner.i).cast(rows.schema[id_col].dataType)))
    return rows.withColumn(out_col, flag)


def with_split(rows: DataFrame, share: float, seed: int = 0, id_col: str = "row_no", out_col: str = "is_validation") -> DataFrame:
    """``rows`` with a flag on a share of them by a seeded hash of their id.

    The hash decides each row alone, so nothing is sorted; the flagged part is
    the share in expectation, and the same however the rows lie.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    return rows.withColumn(out_col, h < F.lit(int(share * (1 << 30))))
