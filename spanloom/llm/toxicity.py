"""A convolutional text classifier for toxicity, trained and run in numpy.

A word is embedded as the sum of five hashed embeddings, of the whole word and
of its first 4 to 7 bytes, so that a stem counts whatever its ending.
Filters of several widths run over the words, each filter's maximum over the
document is kept, and a linear layer scores those.  Each language has its own
threshold, found on labelled documents that training didn't see.

Every labelled document counts.  A few are trained on by the driver; more are
dealt out by a hash of their ids to units, of which each takes the common
model through its documents in every round, and what the units changed is
averaged.  Counts and thresholds are those of all units' documents.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B
from spanloom.llm.store import by_size, discard, materialise, trimmed

#: Rows of a hashed embedding table; five tables of DIM columns are broadcast, 10 MB in all.
BUCKETS_BITS, DIM = 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
#: Up to so many labelled documents, and bytes of them, are one unit that the driver trains on; more are trained on by workers.
DRIVER_DOCS, DRIVER_BYTES = 6500, 32 << 20
#: Documents and bytes of a worker's unit, on average.
UNIT_DOCS, UNIT_BYTES = 5120, 24 << 20
#: Parts in which units' changes are added up.
SLICES = 32
EPOCHS, BATCH, SEED = 8, 32, 7
#: A small table's documents are gone over more often, for so many steps at least.
LEAST_STEPS = 800
#: Step of the embeddings, of which each row has its own decay.
EMBED_STEP = 0.15
#: A bucket that fewer training documents hold isn't learned, as what is met in few of many is noise; among
#: under LEAST_DOCS x DOCS_EACH the floor is one for each DOCS_EACH, FEWEST_DOCS at least.
LEAST_DOCS, DOCS_EACH, FEWEST_DOCS = 6, 100, 2
#: Share of words that a training step leaves out, so that no document rests on one word.
DROPPED = 0.5
#: What a share of clean documents that is rejected costs, against that of toxic ones that stay.
FALSE_COST = 3
#: Documents of each class that a share is counted over besides those that there are.
SMOOTH = 8
#: A language with fewer held-out documents of either class takes the common threshold.
LEAST_HELD_OUT = 8
#: Text worked on at once; small, as each word becomes some 50 floats.
CHUNK = 256 << 10

_PREFIX = (4, 5, 6, 7)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PAD = max(WIDTHS) - 1
_BUCKET = np.uint16 if BUCKETS_BITS <= 16 else np.uint32


def word_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((4, words) buckets, words in each document) of lower-case text."""
    start, length, doc = B.word_spans(raw, offsets)
    buf = B.padded(raw)
    out = np.empty((1 + len(_PREFIX), len(start)), np.int64)
    shift = np.uint64(64 - BUCKETS_BITS)
    if len(start):
        out[0] = (B.hash_slices(buf, start, length) * _MUL[0] >> shift).astype(np.int64)
        head = B.words_at(buf)[start]
        for k, n in enumerate(_PREFIX, 1):
            out[k] = (B.mix64((head & B.low_bytes(np.minimum(length, n))) + _MUL[k]) >> shift).astype(np.int64)
    return out, np.bincount(doc, minlength=len(offsets) - 1)


@dataclass
class Model:
    tables: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    @classmethod
    def new(cls, rng) -> Model:
        return cls(
            np.zeros((1 + len(_PREFIX), 1 << BUCKETS_BITS, DIM), np.float32),
            [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            -1.0,
        )

    def embed(self, buckets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, place of each word, first row of each document); zero rows part the documents."""
        first = np.cumsum(words + _PAD) - (words + _PAD)
        place = np.arange(buckets.shape[1]) + np.repeat(first - (np.cumsum(words) - words), words)
        rows = np.zeros((int((words + _PAD).sum()) + _PAD, DIM), np.float32)
        rows[place] = sum(t[b] for t, b in zip(self.tables, buckets))
        return rows, place, first

    def convolve(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Filter values at each word, before the rectifier; a run that begins between documents would reach into the next and counts for nothing."""
        n = len(rows) - _PAD
        parts = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            parts.append(sum(rows[k : k + n] @ f[k] for k in range(w)) + b)
        out = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        out[place] = np.concatenate(parts, axis=1)[place]
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds of each document."""
        out = np.zeros(len(offsets) - 1, np.float64)
        for i, j in B.doc_chunks(offsets, CHUNK):
            part = raw[offsets[i] : offsets[j]]
            if j == i + 1 and len(part) > 2 * CHUNK:
                # the greatest value over a text is that over overlapping segments of it
                top = np.max([self._top(part[a:b], np.array([0, b - a]), b < len(part)) for a, b in B.segments(part, CHUNK, _PAD)], axis=0)
            else:
                top = self._top(part, offsets[i : j + 1] - offsets[i])
            out[i:j] = np.maximum(top, 0) @ self.out + self.out_bias
        return out

    def score_hashed(self, buckets: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The same of documents whose words are hashed already."""
        out = np.zeros(len(words), np.float64)
        ends = np.concatenate([[0], np.cumsum(words)])
        step = CHUNK // 8
        for i, j in B.doc_chunks(ends, step):
            a, b = int(ends[i]), int(ends[j])
            if j == i + 1 and b - a > 2 * step:
                top = np.max([self._top_hashed(buckets[:, k : min(b, k + step + _PAD)], np.array([min(b, k + step + _PAD) - k]), k + step + _PAD < b) for k in range(a, b - _PAD, step)], axis=0)
            else:
                top = self._top_hashed(buckets[:, a:b], words[i:j])
            out[i:j] = np.maximum(top, 0) @ self.out + self.out_bias
        return out

    def _top(self, raw: np.ndarray, offsets: np.ndarray, goes_on: bool = False) -> np.ndarray:
        """Each filter's greatest value; of a text that goes on the last words' runs are left to its next segment."""
        return self._top_hashed(*word_buckets(raw, offsets), goes_on)

    def _top_hashed(self, buckets: np.ndarray, words: np.ndarray, goes_on: bool = False) -> np.ndarray:
        rows, place, first = self.embed(buckets, words)
        found = self.convolve(rows, place)
        if goes_on:
            found[place[-_PAD:]] = -np.inf
        return np.maximum.reduceat(found, first, axis=0)

    def limit(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.threshold)


def least_docs(sample: int) -> int:
    """Training documents that must hold a bucket, of so many in all."""
    return min(LEAST_DOCS, max(FEWEST_DOCS, sample // DOCS_EACH))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_buckets`` gives of the lower-case texts, two bytes a bucket, run by run: little is held besides the words."""
    raw, offsets, _ = B.text_buffers(pc.utf8_lower(texts))
    parts = [word_buckets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.doc_chunks(offsets)]
    if not parts:
        return np.zeros((1 + len(_PREFIX), 0), _BUCKET), np.zeros(0, np.int64)
    return np.concatenate([b.astype(_BUCKET) for b, _ in parts], axis=1), np.concatenate([n for _, n in parts])


def documents_with(buckets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each table's buckets, how many documents hold them."""
    held = np.zeros((len(buckets), 1 << BUCKETS_BITS), np.int32)
    for e, n in zip(np.cumsum(words).tolist(), words.tolist()):
        for t in range(len(buckets)):
            held[t, np.unique(buckets[t, e - n : e])] += 1
    return held


def class_weights(labels: np.ndarray, toxic: float) -> np.ndarray:
    """Weights with which both classes count alike, ``toxic`` being the share of the one."""
    return np.where(labels > 0, 0.5 / max(toxic, 1e-6), 0.5 / max(1 - toxic, 1e-6)).astype(np.float32)


@dataclass
class State:
    """What a step of training changes: a model, the squares its embeddings' steps have grown by, the moments of all else."""

    model: Model
    grown: np.ndarray
    moments: list[tuple[np.ndarray, np.ndarray]]
    step: int = 0

    @classmethod
    def new(cls, rng) -> State:
        m = Model.new(rng)
        return cls(m, np.full(m.tables.shape[:2], 1e-8, np.float32), [(np.zeros_like(p), np.zeros_like(p)) for p in (*m.filters, *m.bias, m.out)])

    def dense(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.bias, self.model.out]

    def packed(self) -> np.ndarray:
        """A row for each bucket, of its embedding and what its steps have grown by, and as many as all else needs."""
        rest = np.concatenate([*(x.ravel() for x in self.dense()), *(x.ravel() for pair in self.moments for x in pair), [self.model.out_bias, self.step]])
        rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.concatenate([np.concatenate([self.model.tables, self.grown[..., None]], axis=2).reshape(-1, DIM + 1), rest.astype(np.float32)])

    def add(self, change: np.ndarray) -> None:
        """Adds a change of what ``packed`` gives."""
        n = self.grown.size
        part = change[:n].reshape(*self.grown.shape, DIM + 1)
        self.model.tables += part[..., :DIM]
        self.grown += part[..., DIM]
        rest, at = change[n:].ravel(), 0
        for p in (*self.dense(), *(x for pair in self.moments for x in pair)):
            p += rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.model.out_bias += float(rest[at])
        self.step += round(float(rest[at + 1]))

    def epoch(self, rng, buckets: np.ndarray, words: np.ndarray, labels: np.ndarray, weight: np.ndarray, known: np.ndarray) -> None:
        """Goes over hashed documents once, by stochastic gradients."""
        m = self.model
        ends = np.cumsum(words)
        labels = labels.astype(np.float32)
        order = rng.permutation(len(words))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            n = words[pick]
            at = np.concatenate([np.arange(e - k, e) for e, k in zip(ends[pick], n)]) if n.sum() else np.zeros(0, np.int64)
            kept = rng.random(len(at)) >= DROPPED
            n = np.bincount(np.repeat(np.arange(len(pick)), n)[kept], minlength=len(pick))
            b = buckets[:, at[kept]]
            rows, place, first = m.embed(b, n)
            c = m.convolve(rows, place)
            stop = np.append(first[1:], len(c))
            best = np.stack([c[s:e].argmax(axis=0) + s for s, e in zip(first, stop)])
            top = np.take_along_axis(c, best, axis=0)
            on = top > 0
            z = np.where(on, top, 0)
            logit = np.clip(z @ m.out + m.out_bias, -30, 30)
            err = ((1 / (1 + np.exp(-logit)) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = np.where(on, err[:, None] * m.out, 0).astype(np.float32)
            grads: list[np.ndarray] = []
            row_at, row_grad = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                p, g = best[:, cols], back[:, cols]
                d = np.zeros_like(m.filters[k])
                for j in range(w):
                    d[j] = np.einsum("nfd,nf->df", rows[p + j], g)
                    row_at.append((p + j).ravel())
                    row_grad.append((g[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
                grads.append(d)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads.append(z.T @ err)
            self.step += 1
            for p, g, (u, v) in zip(self.dense(), grads, self.moments):
                u *= 0.9
                u += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.01 * (u / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            m.out_bias -= 0.1 * float(err.sum())
            word_of = np.full(len(rows), -1, np.int64)
            word_of[place] = np.arange(len(place))
            where, what = word_of[np.concatenate(row_at)], np.concatenate(row_grad)
            real = where >= 0
            where, what = where[real], what[real]
            for t in range(len(m.tables)):
                i, back_to = np.unique(b[t, where], return_inverse=True)
                g = np.zeros((len(i), DIM), np.float32)
                np.add.at(g, back_to, what)
                i, g = i[known[t][i]], g[known[t][i]]
                self.grown[t, i] += (g * g).mean(axis=1)
                m.tables[t, i] -= EMBED_STEP * g / np.sqrt(self.grown[t, i])[:, None]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of labelled texts, by stochastic gradients; thresholds aren't set."""
    rng = np.random.default_rng(seed)
    state = State.new(rng)
    buckets, words = hashed(pa.array(texts, pa.large_string()))
    known = documents_with(buckets, words) >= least_docs(len(texts))
    labels = labels.astype(np.float32)
    weight = class_weights(labels, labels.mean())
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))):
        state.epoch(rng, buckets, words, labels, weight, known)
    return state.model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the least missed share plus FALSE_COST times the falsely rejected share; among equals, the middle of the widest gap.

    Shares are of the documents and SMOOTH more, so that one of a few toxic
    documents doesn't outweigh several clean ones.
    """
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order] > 0
    missed = np.concatenate([[0], np.cumsum(y)]) / (y.sum() + SMOOTH)
    false = np.concatenate([[0], np.cumsum(~y)])
    false = (false[-1] - false) / ((~y).sum() + SMOOTH)
    low, high = np.concatenate([[s[0] - 2], s]), np.concatenate([s, [s[-1] + 2]])
    cost = missed + FALSE_COST * false
    apart = high > low  # equal scores fall on one side together
    ties = np.flatnonzero(apart & (cost <= cost[apart].min() + 1e-12))
    k = ties[np.argmax((high - low)[ties])]
    return float((low[k] + high[k]) / 2)


def held_out(labels: np.ndarray) -> np.ndarray:
    """Whether a document is left out of training: every fourth of those in the order of their labels."""
    held = np.zeros(len(labels), bool)
    held[np.argsort(-labels, kind="stable")[3::4]] = True
    return held


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A trained model with thresholds from every fourth document, which training doesn't see."""
    if not len(texts) or not 0 < labels.sum() < len(labels):
        empty = Model.new(np.random.default_rng(seed))
        empty.out[:], empty.threshold = 0, 0.0  # nothing to learn from: nothing is toxic
        return empty
    held = held_out(labels)
    m = train([t for t, h in zip(texts, held) if not h], labels[~held], epochs, seed)
    raw, offsets, _ = B.text_buffers(pc.utf8_lower(pa.array([t for t, h in zip(texts, held) if h], pa.large_string())))
    scores, truth = m.score(raw, offsets), labels[held]
    tongue = np.array([x or "" for x, h in zip(langs, held) if h])
    if not 0 < truth.sum() < len(truth):
        return m
    m.threshold = best_threshold(scores, truth)
    for lang in sorted(set(tongue.tolist()) - {""}):
        own = tongue == lang
        if min(truth[own].sum(), (1 - truth[own]).sum()) >= LEAST_HELD_OUT:
            m.thresholds[lang] = best_threshold(scores[own], truth[own])
    return m


class Coded:
    """Buckets of words, of which each distinct word's are held once; read like what ``hashed`` gives."""

    def __init__(self, buckets: np.ndarray, place: np.ndarray):
        self.buckets, self.place = buckets, place

    def __len__(self) -> int:
        return len(self.buckets)

    def __getitem__(self, at) -> np.ndarray:
        return self.buckets[at[0], self.place[at[1]]]


def _distinct(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the distinct words, place of each word among them)."""
    key = np.zeros(buckets.shape[1], np.uint64)
    for row, m in zip(buckets, _MUL):
        key = B.mix64(key + row * m)
    first, place = np.unique(key, return_index=True, return_inverse=True)[1:]
    return buckets[:, first], place


def _units(rows: DataFrame, n: int) -> DataFrame:
    """Labelled documents in ``n`` units by a hash of their ids: a row for those of a unit that are trained on, one for those held out.

    Of an id on several rows the least text counts.  Words are hashed once: a
    unit has a table of its distinct words' buckets and each word's place in it.
    """
    schema = "unit int, held boolean, labels binary, words binary, buckets binary, place binary, langs array<string>"

    def packed(unit: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        labels, words, tables, places = (list(x) for x in list(zip(*parts))[:4])
        first = np.cumsum([0, *(t.shape[1] for t in tables)])
        table, again = _distinct(np.concatenate(tables, axis=1))
        places = np.concatenate([again[first[k] + p].astype(np.uint32) for k, p in enumerate(places)])
        labels, words, langs = np.concatenate(labels), np.concatenate(words), [x for p in parts for x in p[4]]
        held = held_out(labels)
        for side in (False, True):
            own = held == side
            if own.any():
                out = [unit, side, *(x.tobytes() for x in (labels[own], words[own], table, places[np.repeat(own, words)])), [x for x, o in zip(langs, own) if o]]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, (pa.int32(), pa.bool_(), *[pa.large_binary()] * 4, pa.list_(pa.string())))], ["unit", "held", "labels", "words", "buckets", "place", "langs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, parts = None, None, []
        for batch in batches:
            units, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            fresh = np.array([x != y for x, y in zip(ids, [last, *ids])], bool)
            cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if units[i] != now and parts:
                    yield from packed(now, parts)
                    parts = []
                now = int(units[i])
                own = batch.slice(i, j - i).filter(pa.array(fresh[i:j]))
                if len(own):
                    buckets, words = hashed(own.column(3))
                    table, place = _distinct(buckets)
                    parts.append((own.column(2).to_numpy().astype(np.int8), words, table, place.astype(np.uint32), own.column(4).to_pylist()))
            last = ids[-1] if ids else last
        if parts:
            yield from packed(now, parts)

    unit = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("unit")
    dealt = rows.select(unit, "id", "y", "text", "lang").repartitionById(n, "unit").sortWithinPartitions("unit", "id", "text", "lang")
    return materialise(dealt.mapInArrow(trimmed(run), schema), "toxicity-units")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Coded, list[str | None]]]:
    """(unit, labels, words in each document, buckets, languages) of each row of ``_units``."""
    for batch in batches:
        for k in range(batch.num_rows):
            unit, labels, words, buckets, place = (batch.column(x)[k] for x in ("unit", "labels", "words", "buckets", "place"))
            labels, words, buckets, place = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip((labels, words, buckets, place), (np.int8, np.int64, _BUCKET, np.uint32)))
            yield unit.as_py(), labels, words, Coded(buckets.reshape(1 + len(_PREFIX), -1), place), batch.column("langs")[k].as_py()


def _added(units: DataFrame, rows: int, width: int, work) -> tuple[np.ndarray, np.ndarray]:
    """(units that have a row, sum of what they have there) over the (row numbers, values) that ``work`` gives for each unit.

    Rows are added up by task, then by slices of row numbers, so that the
    driver gets one table, however many units there are.
    """
    each = -(-rows // SLICES)
    schema = "slice int, at binary, n binary, total binary"

    def packed(n: np.ndarray, total: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        for k in range(first, first + -(-len(n) // each)):
            part = slice((k - first) * each, (k - first + 1) * each)
            at = np.flatnonzero(n[part])
            if len(at):
                out = [k, at.astype(np.int32).tobytes(), n[part][at].tobytes(), total[part][at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int32(), *[pa.large_binary()] * 3))], ["slice", "at", "n", "total"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(rows, np.int32), np.zeros((rows, width), np.float32)
        for unit in _opened(batches):
            at, values = work(*unit[:4])
            n[at] += 1
            total[at] += values
        yield from packed(n, total, 0)

    def by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                at, n, total = (np.frombuffer(x, kind) for x, kind in zip(row, (np.int32, np.int32, np.float32)))
                own = sums.setdefault(k, (np.zeros(each, np.int64), np.zeros((each, width))))
                own[0][at] += n
                own[1][at] += total.reshape(-1, width)
        for k, own in sums.items():
            yield from packed(*own, k)

    merged = units.filter("NOT held").select("unit", "labels", "words", "buckets", "place", "langs").mapInArrow(trimmed(by_task), schema).repartition("slice").mapInArrow(trimmed(by_slice), schema)
    n, total = np.zeros(each * SLICES, np.int64), np.zeros((each * SLICES, width))
    for k, *row in merged.collect():
        at, m, part = (np.frombuffer(x, kind) for x, kind in zip(row, (np.int32, np.int64, np.float64)))
        n[k * each + at], total[k * each + at] = m, part.reshape(-1, width)
    return n[:rows], total[:rows]


def _train_units(units: DataFrame, n_units: int, docs: int, toxic: float, epochs: int, seed: int) -> Model:
    """A model of all units: in each round each unit goes over its documents from the common model, and each row's change is the mean over the units that changed it."""
    size = (1 + len(_PREFIX)) << BUCKETS_BITS
    times = max(1, round(LEAST_STEPS * BATCH * n_units / (docs * epochs)))  # units of few long documents go over them more often in a round

    def count(unit, labels, words, buckets):
        held = documents_with(buckets, words).ravel()
        at = np.flatnonzero(held)
        return at, held[at, None]

    known = _added(units, size, 1, count)[1].reshape(-1, 1 << BUCKETS_BITS) >= least_docs(docs)
    state = State.new(np.random.default_rng(seed))
    for turn in range(epochs):
        shared = units.sparkSession.sparkContext.broadcast((state, known))

        def go_over(unit, labels, words, buckets, shared=shared, turn=turn):
            common, known = shared.value
            own = copy.deepcopy(common)
            rng = np.random.default_rng([seed, turn, unit])
            for _ in range(times):
                own.epoch(rng, buckets, words, labels, class_weights(labels, toxic), known)
            change = own.packed()
            change -= common.packed()
            at = np.flatnonzero(change.any(axis=1))
            at = np.union1d(at, np.arange(size, len(change)))
            return at, change[at]

        n, total = _added(units, len(state.packed()), DIM + 1, go_over)
        state.add(total / np.maximum(n, 1)[:, None])
        shared.destroy()
    return state.model


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table; as Arrow, since rows of Python objects are read by workers of their own, which stay."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x) for x in zip(*rows)], [x.split()[0] for x in schema.split(", ")]), schema)


def score_bins(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision scores without a negative zero, and the leading 16 bits of each in the order of the scores."""
    score = score + np.float32(0)
    bits = score.view(np.uint32)
    return score, (np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> 16).astype(np.int32)


def thresholds(scored: DataFrame) -> dict[str, tuple[float, int, int]]:
    """What ``best_threshold`` finds, with the numbers of toxic and clean documents, by language of (lang, score float, y) rows; those of all rows under ''.

    Rows that have their ``bin`` by ``score_bins`` already don't go to a worker
    once more: two functions in one task would be two workers, which stay.

    Exact, and of any number of rows: distinct scores are counted, and summed
    up within and over bins of the leading 16 bits of a score, of which each
    has 65536 distinct scores at most.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, place = score_bins(batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(2), pa.array(place)], ["lang", "score", "y", "bin"])

    sums = F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    each = scored if "bin" in scored.columns else scored.select("lang", F.col("score").cast("float"), "y").mapInArrow(trimmed(binned), "lang string, score float, y int, bin int")
    each = each.groupBy("lang", "bin", "score").agg(F.sum("y").cast("long").alias("toxic"), F.sum(1 - F.col("y")).cast("long").alias("clean"))
    own = each.filter("lang <> ''")
    every = each.groupBy(F.lit("").alias("lang"), "bin", "score").agg(*sums)
    counted = materialise(every.unionByName(own), "toxicity-scores")
    bins = counted.groupBy("lang", "bin").agg(*sums, F.min("score").alias("low"), F.max("score").alias("high")).toPandas().sort_values(["lang", "bin"])
    spark = counted.sparkSession
    edges, found = [], {}
    for lang, b in bins.groupby("lang"):
        toxic, clean = int(b.toxic.sum()), int(b.clean.sum())
        found[lang] = [float(b.low.iloc[0]), toxic, clean]
        above = [*b.low.iloc[1:].astype(float), float(b.high.iloc[-1]) + 2]
        edges += [(lang, int(k), int(t), int(c), toxic, clean, nxt) for k, t, c, nxt in zip(b.bin, b.toxic.cumsum() - b.toxic, b.clean.cumsum() - b.clean, above)]
    if not edges:
        discard(counted)
        return {}
    edge = _table(spark, edges, "lang string, bin int, t0 long, c0 long, toxic_all long, clean_all long, next double")
    within = Window.partitionBy("lang", "bin").orderBy("score")
    cuts = counted.withColumns({"t": F.sum("toxic").over(within), "c": F.sum("clean").over(within), "up": F.lead("score").over(within).cast("double")}).join(F.broadcast(edge), ["lang", "bin"])
    missed = (F.col("t0") + F.col("t")) / (F.col("toxic_all") + SMOOTH)
    false = (F.col("clean_all") - F.col("c0") - F.col("c")) / (F.col("clean_all") + SMOOTH)
    cuts = cuts.select("lang", (missed + FALSE_COST * false).alias("cost"), F.col("score").cast("double").alias("low"), F.coalesce("up", "next").alias("high"))
    # the cut below all scores
    below = _table(spark, [(k, FALSE_COST * (clean / (clean + SMOOTH)), low - 2, low) for k, (low, _, clean) in found.items()], "lang string, cost double, low double, high double")
    cuts = cuts.unionByName(below)
    least = _table(spark, [tuple(r) for r in cuts.groupBy("lang").agg(F.min("cost")).collect()], "lang string, least double")
    widest = cuts.join(F.broadcast(least), "lang").filter(F.col("cost") <= F.col("least") + 1e-12).groupBy("lang").agg(F.max(F.struct(F.col("high") - F.col("low"), -F.col("low"), "high")).alias("best")).collect()
    discard(counted)
    return {r.lang: ((-r.best[1] + r.best[2]) / 2, *found[r.lang][1:]) for r in widest}


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of all labelled documents, every fourth of which is left out of training and sets the thresholds.

    An id that is labelled both ways is toxic; of an id on several rows the least text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL")
    rows = texts.join(by_size(known, known.count()), "id")
    n, size, toxic = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.sum("y")).first()
    if not n or not 0 < toxic < n:
        return fit([], np.zeros(0), [])
    if n <= DRIVER_DOCS and size <= DRIVER_BYTES:
        few = rows.select("id", "y", "lang", "text").toPandas().sort_values(["id", "text", "lang"], kind="stable").drop_duplicates("id")
        return fit(few.text.tolist(), few.y.to_numpy(), few.lang.where(few.lang.notna(), None).tolist(), epochs, seed)
    n_units = max(-(-n // UNIT_DOCS), -(-size // UNIT_BYTES))
    units = _units(rows, n_units)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [np.frombuffer(x, np.int8) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in y], pa.int64()), pa.array([int(x.sum()) for x in y], pa.int64())], ["n", "toxic"])

    n, toxic = units.filter("NOT held").select("labels").mapInArrow(trimmed(tally), "n long, toxic long").agg(F.sum("n"), F.sum("toxic")).first()
    m = _train_units(units, n_units, n, toxic / n, epochs, seed)
    shared = units.sparkSession.sparkContext.broadcast(m)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, words, buckets, langs in _opened(batches):
            scores, place = score_bins(shared.value.score_hashed(buckets, words).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in langs]), pa.array(scores), pa.array(y.astype(np.int32)), pa.array(place)], ["lang", "score", "y", "bin"])

    found = thresholds(units.filter("held").mapInArrow(trimmed(score), "lang string, score float, y int, bin int"))
    shared.destroy()
    discard(units)
    common, bad, good = found.pop("", (0.0, 0, 0))
    if min(bad, good):
        m.threshold = common
        m.thresholds = {k: t for k, (t, *both) in sorted(found.items()) if min(both) >= LEAST_HELD_OUT}
    return m


def _scored(model, batch, text, lang):
    raw, offsets, valid = B.text_buffers(pc.utf8_lower(batch.column(text)))
    score = model.score(raw, offsets)
    limits = np.array([model.limit(x) for x in batch.column(lang).to_pylist()])
    # a text of which no filter sees anything gives no evidence of anything
    return score, valid, (score > limits) & valid & (score != model.out_bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, toxic_score, is_toxic) of each row; the score is a probability.

    A null text has a null score and isn't toxic; an empty one, or any in which
    no filter sees anything, has the score of no evidence and isn't toxic.  An unknown or null language takes the common
    threshold; a score equal to its threshold isn't toxic.  Repeated rows are
    scored each; other columns aren't read.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, valid, toxic = _scored(shared.value, batch, 1, 2)
            p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, mask=~valid), pa.array(toxic)], [id_col, "toxic_score", "is_toxic"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_sl_text"), F.col(lang_col).cast("string").alias("_sl_lang"))
    return wanted.mapInArrow(trimmed(run), f"`{id_col}` {wanted.schema[0].dataType.simpleString()}, toxic_score double, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns, judged as ``score_toxicity`` does.

    Rows of a null or an empty text stay, repeated rows are judged each, and
    an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang = names.index(text_col), names.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, toxic = _scored(shared.value, batch, text, lang)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(trimmed(run), docs.schema)
