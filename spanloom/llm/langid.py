"""Language identification with string kernels.

The kernel of two texts counts the n-grams of 1 to 4 bytes that both hold
(blended spectrum, presence only), divided by the root of the product of their
own counts.  N-grams are told apart by a hash into ``FEATURES`` places.  A
Nyström map on landmark texts turns it into few dimensions, in which one
ridge regression a language is fitted.  As kernel values against landmarks are
linear in a text's presence vector, a batch of texts is scored by one product
of its presence matrix with a FEATURES x languages matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B

SPECTRUM = (1, 2, 3, 4)
FEATURES_BITS = 14
#: At most so many documents of a language are fetched to train on; so many of them are landmarks.
SAMPLE, LANDMARKS = 400, 40
RIDGE = 0.1
#: Documents whose presence rows are held at once, and bytes that are hashed at once.
ROWS, STEP = 128, 1 << 20

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of 0 and 1: which hashed n-grams each lower-case text holds."""
    docs, n = len(offsets) - 1, len(raw)
    out = np.zeros(docs << FEATURES_BITS, np.uint8)
    if n:
        view, shift = B.words_at(B.padded(raw))[:n], np.uint64(64 - FEATURES_BITS)
        for a in range(0, n, STEP):  # a long text is gone through in steps
            place = np.arange(a, min(n, a + STEP))
            doc = np.searchsorted(offsets, place, side="right") - 1
            base, left = doc << FEATURES_BITS, offsets[doc + 1] - place
            for size, mul in zip(SPECTRUM, _MUL):
                h = ((view[a : a + STEP] & B._LOW[size]) * mul + mul) * _MUL[0] >> shift
                at = base + h.astype(np.int64)
                out[at if size == 1 else at[left >= size]] = 1
    return out.reshape(docs, -1)


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in B.doc_chunks(offsets, 1 << 20):
        for a in range(i, j, ROWS):
            yield a, min(a + ROWS, j)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages); a text without bytes scores 0 throughout."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in _blocks(offsets):
            x = presence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
            out[i:j] = (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        return out


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström landmarks, the same number of each language, and one-versus-rest ridge regression."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << FEATURES_BITS, 0), np.float32))
    raw, offsets, _ = B.text_buffers(pc.utf8_lower(pa.array(texts, pa.large_string())))
    marks = [i for k in names for i in [i for i, x in enumerate(langs) if x == k][:landmarks]]
    unit = lambda i, j: (x := presence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    points = np.concatenate([unit(i, i + 1) for i in marks])
    kernel = np.concatenate([unit(i, j) @ points.T for i, j in _blocks(offsets)]).astype(np.float64)
    value, vector = np.linalg.eigh((points @ points.T).astype(np.float64))
    real = value > 1e-6 * value.max()
    to_map = vector[:, real] / np.sqrt(value[real])
    z = kernel @ to_map
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return Model(names, (points.T.astype(np.float64) @ (to_map @ w)).astype(np.float32))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model of at most ``sample`` documents of each known language, taken by a hash of their ids."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    count = {r.lang: r.n for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not count:
        return fit([], [])
    # a hash threshold a language keeps about the sample without sorting texts; what is over is cut here
    share = F.create_map([x for k, n in count.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample / n)))])
    rows = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).toPandas()
    rows = rows.sort_values("id", kind="stable").groupby("lang", sort=True).head(sample)
    return fit(rows.text.tolist(), rows.lang.tolist(), landmarks)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, predicted_lang, margin) of each row, over its whole text.

    The margin is the best score less the next one; ties go to the first
    language by name.  A null or empty text, or a model of no languages, gives
    null for both.  Repeated rows are answered each; other columns aren't
    read.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, object)
        for batch in batches:
            raw, offsets, valid = B.text_buffers(pc.utf8_lower(batch.column(1)))
            none = ~valid | (np.diff(offsets) == 0)
            if not len(names):
                best, margin, none = np.full(len(none), None, object), np.zeros(len(none)), np.ones(len(none), bool)
            else:
                s = m.scores(raw, offsets)
                best = names[s.argmax(axis=1)]
                top = np.sort(s, axis=1)
                margin = top[:, -1] - top[:, -2] if len(names) > 1 else top[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string(), mask=none), pa.array(margin.astype(float), mask=none)], [id_col, "predicted_lang", "margin"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_sl_text"))
    return wanted.mapInArrow(run, f"`{id_col}` {wanted.schema[0].dataType.simpleString()}, predicted_lang string, margin double")
