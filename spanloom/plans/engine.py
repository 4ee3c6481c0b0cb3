"""The engine: a tokeniser, an emitter and a decoder over DataFrames of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.arrays import PART_BYTES, bounded_batches, give_back, parts_of, rows_of
from spanloom.functions.labels import LabelTable, label_table
from spanloom.functions.offsets import to_chars
from spanloom.operators import bpe, decode, post, redact
from spanloom.operators.forward import BATCH_TOKENS, Config, emissions, log_softmax, logits_of_texts, with_emissions
from spanloom.operators.rules import RULES, rule_spans
from spanloom.operators.windows import WINDOW

VERSION = 1
#: Log-probabilities that are decoded together; four bytes each, and about twice that beside them.
EMISSIONS = 1 << 23
ENTITIES = "array<struct<start:int,end:int,score:float,label:string>>"


@dataclass(frozen=True)
class Engine:
    """Finds and redacts private spans; errors are a row's or a call's own, none sticks.

    Without weights the rules emit the spans: they aren't a trained model.
    With ``config``, ``load`` and ``vocabulary`` the model does.
    """

    rules: tuple = RULES
    vocabulary: bpe.Vocabulary | None = None
    config: Config | None = None
    load: Callable[[], dict[str, np.ndarray]] | None = None
    labels: tuple[str, ...] = ()
    window: int = WINDOW
    threshold: float = 0.5

    @classmethod
    def from_gguf(cls, path: str, **options) -> Engine:
        """An engine of a model file; raises ModelFileError if it can't be run."""
        from spanloom.sources.gguf import ModelFile

        f = ModelFile(path)
        f.weights()
        tokens, merges = f.metadata.get("tokenizer.ggml.tokens"), f.metadata.get("tokenizer.ggml.merges")
        vocabulary = bpe.vocabulary_of(tokens, merges) if tokens and merges is not None else None

        def load(kept={}):  # noqa: B006
            if path not in kept:
                kept[path] = ModelFile(path).weights()
            return kept[path]

        return cls(vocabulary=vocabulary, config=f.config, load=load, labels=tuple(f.labels), **options)

    def with_window(self, tokens: int) -> Engine:
        return replace(self, window=tokens)

    @property
    def table(self) -> LabelTable:
        return label_table(self.labels)

    def info(self, spark: SparkSession) -> DataFrame:
        """(key, value): what the engine runs."""
        from spanloom.sources.sinks import summary

        own = {"emitter": "model" if self.config else "rules", "window": self.window, "threshold": self.threshold, "labels": len(self.labels) or len(self.rules)}
        return summary(spark, own | (self.config.as_row() if self.config else {}))

    def tokenize(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with tokens (id, start, end), in bytes."""
        if self.vocabulary is None:
            raise ValueError("the engine has no vocabulary")
        return bpe.tokenize(docs, self.vocabulary, text_col)

    def logits(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, tok_pos, logits, logp) of every token."""
        if self.config is None or self.load is None:
            raise ValueError("the engine has no model")
        ids = self.tokenize(docs.select(id_col, text_col), text_col).select(id_col, F.transform("tokens", lambda t: t["id"]).alias("ids"))
        return emissions(ids.filter("size(ids) > 0"), self.config, self.load, "ids", self.window)

    def classify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
        """``docs`` with entities (start, end, score, label), in bytes; null for a null text."""
        limit = self.threshold if threshold is None else threshold
        if self.config is None:
            spans = F.filter(rule_spans(text_col, self.rules), lambda s: s["score"] >= F.lit(limit).cast("float"))
            return docs.withColumn("entities", post.clean(text_col, spans).cast(ENTITIES))
        find, names = self._finder(docs.sparkSession, limit), pa.array(list(self.table.categories), pa.string())
        rest = docs.drop("entities")
        kept, schema = rest.columns, T.StructType([*rest.schema.fields, T.StructField("entities", T._parse_datatype_string(ENTITIES))])
        bounded_batches(docs.sparkSession)

        def run(batches):
            try:
                for batch in batches:
                    column = batch.column(batch.num_columns - 1)
                    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for a, b in parts_of(sizes, PART_BYTES):
                        part = batch.slice(a, b - a)
                        texts = part.column(batch.num_columns - 1)
                        counts, (start, end, cat, score) = find(texts.to_pylist())
                        spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float32()), names.take(pa.array(cat))], ["start", "end", "score", "label"])
                        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                        made = pa.ListArray.from_arrays(ends, spans, mask=texts.is_null() if texts.null_count else None)
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*kept, "entities"])
            finally:
                give_back()

        return rest.withColumn(self.TEXT, docs[text_col].cast("binary")).mapInArrow(run, schema)

    def entity_rows(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float | None = None) -> DataFrame:
        """(keys, start, end, label, score): a row for each entity that the model finds, made in the worker."""
        find, names = self._finder(docs.sparkSession, self.threshold if threshold is None else threshold), pa.array(list(self.table.categories), pa.string())

        def make(texts):
            counts, (start, end, cat, score) = find(texts)
            return counts, [start, end, names.take(pa.array(cat)), score.astype(np.float64)]

        return rows_of(docs, keys, [F.col(text_col).cast("binary")], "start bigint, end bigint, label string, score double", make)

    def _finder(self, spark: SparkSession, limit: float):
        """A maker of entities from texts (bytes): how many each has; start, end, category and score of each.

        Texts are tokenised together, and go through the forward pass up to
        EMISSIONS log-probabilities (or BATCH_TOKENS tokens) at once, where one text isn't longer.
        """
        if self.vocabulary is None or self.load is None or self.config is None:
            raise ValueError("the engine has no model")
        shared, of = spark.sparkContext.broadcast(self.vocabulary), decode.strict_arrays(self.table, limit)
        config, load, window, person = self.config, self.load, self.window, np.array([c == "private_person" for c in self.table.categories], bool)

        def find(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
            flat, ends = bpe.encode_texts(shared.value, texts)
            ends, counts, found = ends.astype(np.int64), [], []
            for a, b in parts_of(np.diff(ends), max(BATCH_TOKENS, EMISSIONS // config.classes)):
                ids = np.split(flat[ends[a] : ends[b], 0].astype(np.int64), ends[a + 1 : b] - ends[a])
                n, values = of([log_softmax(x) for x in logits_of_texts(config, load(), ids, window)])
                counts.append(n)
                found.append(values)
            if not found:
                return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.float32)]
            row = np.repeat(np.arange(len(texts)), np.concatenate(counts))
            cat, first, last, score = (np.concatenate([x[k] for x in found]) for k in range(4))
            which, start, end = post.clean_bytes([x or b"" for x in texts], row, flat[ends[row] + first, 1], flat[ends[row] + last, 2], person[cat] if len(cat) else np.zeros(0, bool))
            return np.bincount(row[which], minlength=len(texts)), [start, end, cat[which], score[which]]

        return find

    #: Names of columns that live only within a plan.
    TOKENS, OUT, TEXT = "_sl_tokens", "_sl_out", "_sl_text"

    def _emitted(self, docs: DataFrame, text_col: str, of, kind: str) -> DataFrame:
        """``docs`` with its tokens and what ``of`` makes of their log-probabilities, in the row: ids may repeat or be null."""
        if self.vocabulary is None or self.load is None:
            raise ValueError("the engine has no model")
        laid = bpe.tokenize(docs, self.vocabulary, text_col, self.TOKENS)
        return with_emissions(laid, self.config, self.load, of, self.OUT, kind, self.TOKENS, self.window)

    def classify_lenient(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with spans (start, end, label) in code points: each token's best class, the forgiving reading, targets, merging.

        No threshold applies.  A null text gives null.
        """
        found = self._emitted(docs, text_col, decode.best_classes(self.table), "array<string>")
        tokens = F.col(self.TOKENS)
        laid = found.withColumns({self.OUT + "_s": F.transform(tokens, lambda t: t["start"]), self.OUT + "_e": F.transform(tokens, lambda t: t["end"])})
        spans = decode.lenient(self.OUT, self.OUT + "_s", self.OUT + "_e")
        return laid.withColumn("spans", F.when(F.col(text_col).isNotNull(), post.clean_lenient(text_col, to_chars(text_col, spans)))).select(*docs.drop("spans").columns, "spans")

    def redact(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: bool = False, replacement: str = "***", threshold: float | None = None) -> DataFrame:
        """``docs`` with entities and redacted: the text with each entity replaced, by its tag where ``labels``."""
        found = self.classify(docs, id_col, text_col, threshold)
        return found.withColumn("redacted", redact.redact(text_col, "entities", None if labels else replacement))


def register_sql(spark: SparkSession) -> None:
    """SQL functions of the session: sl_pieces, sl_rule_spans, sl_redact, sl_redaction_tag."""
    from spanloom.functions.pretoken import PATTERN

    # a SQL UDF is inlined by Catalyst; the pattern is a raw string literal
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sl_pieces(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, r\"{PATTERN}\", 0)")
    from spanloom.functions.labels import OTHER_TAG, REDACTION_TAGS

    cases = ", ".join(f"'{k}', '{v}'" for k, v in sorted(REDACTION_TAGS.items()))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sl_redaction_tag(l STRING) RETURNS STRING RETURN coalesce(element_at(map({cases}), l), '{OTHER_TAG}')")
    expr = "t"
    for label, pattern in RULES:
        expr = f"regexp_replace({expr}, r\"{pattern}\", '{REDACTION_TAGS.get(label, OTHER_TAG)}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sl_redact(t STRING) RETURNS STRING RETURN {expr}")
    spark.udtf.register("sl_pretokens", F.udtf(Pretokens, returnType="start: int, end: int, piece: string"))


class Pretokens:
    """The table function sl_pretokens(text): a row (start, end, piece) for each pre-token, in bytes; none for a null."""

    def eval(self, text: str | None):
        from spanloom.functions.pretoken import byte_spans

        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        for start, end in byte_spans(raw):
            yield start, end, raw[start:end].decode("utf-8", "replace")


def device(name: str) -> tuple[str, int]:
    """(kind, number) of a device string; on a cluster it chooses a resource profile, not a driver."""
    kind, _, k = name.partition(":")
    if kind not in ("cpu", "gpu", "cuda", "vulkan") or (k and not k.isdigit()):
        raise ValueError(f"unknown device {name!r}")
    return kind, int(k or 0)


def session_options(name: str = "cpu", threads: int = 0) -> dict[str, str]:
    """Spark settings for a device and a number of threads a task; 0 threads leaves the choice to the session."""
    kind, _ = device(name)
    out = {} if threads <= 0 else {"spark.task.cpus": str(threads), "spark.executorEnv.OMP_NUM_THREADS": str(threads)}
    if kind != "cpu":
        out |= {"spark.executor.resource.gpu.amount": "1", "spark.task.resource.gpu.amount": "1"}
    return out


def cli_options(args: list[str]) -> dict:
    """Options of the text modes: a bare number is a threshold, any other bare word a device."""
    out, rest = {"threshold": 0.5, "device": "cpu", "labels": False, "replacement": "***"}, list(args)
    while rest:
        a = rest.pop(0)
        if a == "--labels":
            out["labels"] = True
        elif a in ("--threshold", "-t", "--device", "-d", "--replacement"):
            if not rest:
                raise ValueError(f"{a} needs a value")
            key = {"-t": "threshold", "-d": "device"}.get(a, a.lstrip("-"))
            out[key] = float(rest.pop(0)) if key == "threshold" else rest.pop(0)
        elif a.startswith("-"):
            raise ValueError(f"unknown option {a}")
        else:
            try:
                out["threshold"] = float(a)
            except ValueError:
                out["device"] = a
    return out
