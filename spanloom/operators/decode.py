"""From label scores of tokens to spans.

Two decoders, as two modes: ``strict`` finds the best path that BIOES allows
(Viterbi), ``lenient`` reads each token's best label and forgives what doesn't
fit.  Both walk a document's tokens in order, so a document is one group; its
emissions stay arrays, a row a token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import parts_of
from spanloom.functions.labels import B, E, I, O, S, LabelTable

SPAN_ARRAY = "array<struct<cat:int,tok_begin:int,tok_end:int,score:float>>"


def viterbi(table: LabelTable, emit: np.ndarray) -> np.ndarray:
    """The best closed path of classes for (tokens, classes) log-scores, ties to the least class; in float32.

    Where no closed path has a finite score, each token's best class.
    """
    n, classes = emit.shape
    if n == 0:
        return np.zeros(0, np.int64)
    emit = emit.astype(np.float32)
    tag, cat = np.array(table.tag), np.array(table.category)
    closed = np.flatnonzero((tag == O) | (tag == E) | (tag == S))
    fresh, goes_on = (tag == O) | (tag == B) | (tag == S), (tag == I) | (tag == E)
    cont = np.flatnonzero(goes_on)
    none = np.float32(-np.inf)
    begin, inside = (np.array([x[c] for c in cat[cont]], np.int64) for x in (table.begin, table.inside))
    score = np.where(fresh, emit[0], none)
    back = np.full((n, classes), -1, np.int32)
    for t in range(1, n):
        best = closed[np.argmax(score[closed])] if len(closed) else -1
        new = np.full(classes, none, np.float32)
        if best >= 0 and score[best] > none:
            new[fresh] = score[best] + emit[t, fresh]
            back[t, fresh] = best
        if len(cont):
            by_b = np.where(begin >= 0, score[begin], none)
            by_i = np.where(inside >= 0, score[inside], none)
            later = by_i > by_b
            from_ = np.where(later, inside, begin)
            value = np.where(later, by_i, by_b)
            ok = value > none
            new[cont[ok]] = value[ok] + emit[t, cont[ok]]
            back[t, cont[ok]] = from_[ok]
        score = new
    last = closed[np.argmax(score[closed])] if len(closed) else -1
    if last < 0 or not score[last] > none:
        return emit.argmax(axis=1)
    path = np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        path[t] = last
        last = back[t, last]
    return path


def viterbi_many(table: LabelTable, texts: list[np.ndarray]) -> list[np.ndarray]:
    """``viterbi`` of each text, all texts of a run taking each step together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    for a, b in parts_of(np.array([len(texts[i]) for i in order], np.int64), CELLS):
        for i, path in zip(order[a:b], _viterbi_run(table, [texts[i] for i in order[a:b]])):
            out[i] = path
    return out


#: Tokens of texts that are decoded together, where one text isn't longer.
CELLS = 1 << 20


def _viterbi_run(table: LabelTable, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Texts by falling length; at each step those that go on are the first ones.

    Scores are (classes, texts), classes that may follow a closed one ahead.
    The tokens of a step lie together, so short texts aren't filled up.  What
    a finite score came from is finite too, so a step keeps only which closed
    class was best and, for I and E, whether I was better than B.
    """
    tag, cat = np.array(table.tag), np.array(table.category)
    closed = np.flatnonzero((tag == O) | (tag == E) | (tag == S))
    if not len(closed):
        return [x.astype(np.float32).argmax(axis=1) for x in texts]
    goes_on = (tag == I) | (tag == E)
    classes = np.concatenate([np.flatnonzero((tag == O) | (tag == B) | (tag == S)), np.flatnonzero(goes_on)])
    fresh, all_ = int((~goes_on).sum()), len(classes)
    place = np.full(len(tag) + 1, all_)  # the last row is of classes that aren't there
    place[classes] = np.arange(all_)
    begin, inside = (place[np.array([x[c] for c in cat[classes[fresh:]]], np.int64)] for x in (table.begin, table.inside))
    ends = place[closed]
    lengths = np.array([len(x) for x in texts])
    going = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts of more than t tokens
    off = np.concatenate([[0], np.cumsum(going)])
    at = [off[:n] + i for i, n in enumerate(lengths.tolist())]
    emit = np.empty((all_, off[-1]), np.float32)
    for x, own in zip(texts, at):
        emit[:, own] = x.astype(np.float32).T[classes]
    best, later = np.empty(off[-1], np.int16), np.empty((all_ - fresh, off[-1]), bool)
    score = np.full((all_ + 1, len(texts)), -np.inf, np.float32)
    score[:fresh] = emit[:fresh, : len(texts)]
    steps = off.tolist()
    for t in range(1, len(steps) - 1):
        a, b = steps[t], steps[t + 1]
        old = score[:, : b - a]
        shut, by_b, by_i = old.take(ends, 0), old.take(begin, 0), old.take(inside, 0)
        best[a:b] = shut.argmax(0)
        np.greater(by_i, by_b, out=later[:, a:b])
        np.add(shut.max(0), emit[:fresh, a:b], out=old[:fresh])
        np.add(np.maximum(by_i, by_b), emit[fresh:, a:b], out=old[fresh:all_])
    shut = score.take(ends, 0)
    last, finite = shut.argmax(0).tolist(), (shut.max(0) > -np.inf).tolist()
    ends, begin, inside, out = ends.tolist(), [-1] * fresh + begin.tolist(), [-1] * fresh + inside.tolist(), []
    for i, (x, own) in enumerate(zip(texts, at)):
        if not finite[i]:
            out.append(x.astype(np.float32).argmax(axis=1))
            continue
        from_shut, from_i = best[own].tolist(), [b""] * fresh + [y[own].tobytes() for y in later]
        k, path = ends[last[i]], []
        for t in range(len(x) - 1, 0, -1):
            path.append(k)
            k = ends[from_shut[t]] if k < fresh else inside[k] if from_i[k][t] else begin[k]
        path.append(k)
        out.append(classes[path[::-1]])
    return out


def strict_spans(table: LabelTable, threshold: float):
    """A maker of Arrow arrays of spans (SPAN_ARRAY) from the log-probabilities of texts."""
    arrays = strict_arrays(table, threshold)

    def of(texts: list[np.ndarray]) -> pa.Array:
        counts, values = arrays(texts)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float32())
        made = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(values, kinds)], ["cat", "tok_begin", "tok_end", "score"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), made)

    return of


def strict_arrays(table: LabelTable, threshold: float):
    """The same spans as arrays: how many each text has; category, first and last token and score of each."""

    def of(texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        found = [[x for x in assemble(table, path, emit) if x[3] >= np.float32(threshold)] for path, emit in zip(viterbi_many(table, texts), texts)]
        flat = [x for spans in found for x in spans]
        kinds = (np.int32, np.int64, np.int64, np.float32)
        return np.array([len(x) for x in found], np.int64), [np.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)]

    return of


def best_classes(table: LabelTable):
    """A maker of Arrow arrays of each token's best label, ties to the least class."""
    names = pa.array(list(table.labels))

    def of(texts: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int32)
        best = np.concatenate([x.argmax(axis=1) for x in texts]) if texts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(ends, names.take(pa.array(best)))

    return of


def assemble(table: LabelTable, path: np.ndarray, emit: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(category, first token, last token, mean probability) of a path's spans.

    In a path that BIOES doesn't allow, an I of another category is passed
    over and an E of another one drops the span.
    """
    prob = np.exp(emit[np.arange(len(path)), path].astype(np.float32)).astype(np.float64)
    out, begin, open_cat, total = [], -1, -1, 0.0
    for t, k in enumerate(path.tolist()):
        tag, cat = table.tag[k], table.category[k]
        if tag == I:
            if begin >= 0 and cat == open_cat:
                total += prob[t]
            continue
        if tag == B:
            begin, open_cat, total = t, cat, prob[t]
            continue
        if tag == S:
            out.append((cat, t, t, float(np.float32(prob[t]))))
        elif tag == E and begin >= 0 and cat == open_cat:
            out.append((cat, begin, t, float(np.float32((total + prob[t]) / (t - begin + 1)))))
        begin = -1
    return out


def _gathered(emissions: DataFrame, id_col: str) -> DataFrame:
    """A row a document with its tokens (tok_pos, logp) in order."""
    pairs = F.struct(F.col("tok_pos").cast("int").alias("tok_pos"), F.col("logp").cast("array<float>").alias("logp"))
    return emissions.groupBy(id_col).agg(F.array_sort(F.collect_list(pairs), lambda a, b: a["tok_pos"] - b["tok_pos"]).alias("_t"))


def _emissions(column: pa.Array) -> list[np.ndarray]:
    logp = column.flatten().field("logp")
    flat = logp.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat.reshape(len(logp), -1), ends[:-1]) if len(column) else []


def decode_strict(emissions: DataFrame, table: LabelTable, threshold: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """(id, spans) of each document of (id, tok_pos, logp); spans of a lower score than the threshold go.

    One shuffle by document, whose tokens are one task's work; many documents
    are decoded together.  Rows of a null id are one document.
    """
    kind, of = emissions.schema[id_col].dataType.simpleString(), strict_spans(table, threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), of(_emissions(batch.column(1)))], [id_col, "spans"])

    return _gathered(emissions, id_col).mapInArrow(run, f"`{id_col}` {kind}, spans {SPAN_ARRAY}")


def paths_strict(emissions: DataFrame, table: LabelTable, id_col: str = "doc_id") -> DataFrame:
    """(id, tok_pos, class_id, prob): the path itself."""
    kind = emissions.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, column = _emissions(batch.column(1)), batch.column(1)
            path = viterbi_many(table, texts)
            row = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            prob = np.concatenate([np.exp(x[np.arange(len(p)), p]).astype(np.float64) for x, p in zip(texts, path)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), column.flatten().field("tok_pos"), pa.array(np.concatenate(path).astype(np.int32)), pa.array(prob)], [id_col, "tok_pos", "class_id", "prob"])

    return _gathered(emissions, id_col).mapInArrow(run, f"`{id_col}` {kind}, tok_pos int, class_id int, prob double")


def spans_of_paths(paths: DataFrame, id_col: str = "doc_id", pos_col: str = "tok_pos", tag_col: str = "tag", category_col: str = "category", prob_col: str = "prob") -> DataFrame:
    """(id, category, tok_begin, tok_end, score) of valid paths of (tag, category, prob), as gaps and islands.

    One shuffle by document serves the window and the grouping.
    """
    w = Window.partitionBy(id_col).orderBy(pos_col)
    numbered = paths.withColumn("_n", F.sum(F.when(F.col(tag_col).isin("B", "S"), 1).otherwise(0)).over(w)).filter(F.col(tag_col) != "O")
    return (
        numbered.groupBy(id_col, "_n")
        .agg(F.first(category_col).alias("category"), F.min(pos_col).alias("tok_begin"), F.max(pos_col).alias("tok_end"), F.avg(prob_col).alias("score"))
        .drop("_n")
    )


def lenient_spans(labels: list[str], starts: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, category) by the forgiving reading.

    A B or S ends what is open; an I or E of another category than the open
    one ends it and opens its own; tokens of no width are passed over.
    """
    out: list[tuple[int, int, str]] = []
    cat, first, last = None, 0, 0
    for label, s, e in zip(labels, starts, ends):
        if s == e:
            continue
        tag, _, name = label.partition("-")
        if tag in ("I", "E") and cat is not None and name == cat:
            last = e
        else:
            if cat is not None:
                out.append((first, last, cat))
            cat, first, last = (None if tag not in ("B", "S", "I", "E") else name), s, e
            if tag == "E":
                continue  # an orphan E opens a span that stays open
        if cat is not None and tag in ("S", "E"):
            out.append((first, last, cat))
            cat = None
    if cat is not None:
        out.append((first, last, cat))
    return out


def lenient(labels, starts, ends):
    """Array of (start, end, label) of a row's labels and token offsets; null gives null."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    @F.arrow_udf("array<struct<start:int,end:int,label:string>>")
    def run(labels: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(labels.to_pylist(), starts.to_pylist(), ends.to_pylist())
        return pa.array([None if x is None or a is None or b is None else [{"start": s, "end": e, "label": c} for s, e, c in lenient_spans(x, a, b)] for x, a, b in rows], kind)

    return run(labels, starts, ends)


def decode_lenient(tokens: DataFrame, labels_col: str = "labels", starts_col: str = "starts", ends_col: str = "ends") -> DataFrame:
    """``tokens`` (a row a document: labels, starts, ends) with spans (start, end, label) in place of the labels."""
    return tokens.withColumn("spans", lenient(labels_col, starts_col, ends_col)).drop(labels_col, starts_col, ends_col)


def best_labels(emissions: DataFrame, table: LabelTable, id_col: str = "doc_id") -> DataFrame:
    """(id, tok_pos, label) by each token's best class, ties to the least."""
    from spanloom.operators.windows import argmax

    names = F.array(*map(F.lit, table.labels))
    return emissions.select(id_col, "tok_pos", F.element_at(names, argmax("logp") + 1).alias("label"))
