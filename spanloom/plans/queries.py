"""The registered queries of the span engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.functions import pretoken
from spanloom.functions.offsets import char_offset
from spanloom.operators import bpe, datasets, decode, evaluate, post, present, redact, windows
from spanloom.operators.forward import Config, random_weights
from spanloom.operators.rules import RULES, rule_spans
from spanloom.plans.engine import Engine
from spanloom.sources import sinks
from spanloom.streaming.documents import read_documents, redact_stream, run_once

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
BIOES = ("O", *(f"{t}-{c}" for c in ("X", "Y") for t in "BIES"))
#: A class for each of the 64 dimensions of an embedding; the last category has no S.
WIDE_BIOES = ("O", *(f"{t}-C{c}" for c in range(16) for t in "BIES"))[:64]
#: The second detector that evaluation queries score against the first.
OTHER_RULES = tuple((k, p) for k, p in RULES if k not in ("private_phone", "private_date", "IPADDRESS")) + (
    ("private_phone", r"[0-9]{3}[ -][0-9]{4}\b"), ("IPADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), ("private_date", r"\b[0-9]{4}-[0-9]{2}\b"),
)


#: Tables of texts, over which queries compute more than they read.
TEXTS = ("documents", "conversations", "pages")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of texts that lies in fewer row groups than there are cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table in TEXTS and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n.rpartition(".")[2]) for n in names]


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return f"{base.rstrip('/')}/spanloom/{uuid.uuid4().hex}"


def classify_documents(spark, sf_dir):
    """Every entity of every document: byte offsets, label."""
    found = Engine().classify(_read(spark, sf_dir, "documents")).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", *_long("e.start", "e.end"), "e.label")


def redact_fixed(spark, sf_dir):
    """Every document with its entities as ***."""
    return Engine().redact(_read(spark, sf_dir, "documents")).select("doc_id", "redacted")


def redact_labels(spark, sf_dir):
    """Every document with its entities as tags."""
    return Engine().redact(_read(spark, sf_dir, "documents"), labels=True).select("doc_id", "redacted")


def mask_documents(spark, sf_dir):
    """Every document with a block for each character of an entity."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", redact.mask("text", rule_spans("text", unit="chars")).alias("masked"))


def entity_counts(spark, sf_dir):
    """Entities by label."""
    return evaluate.category_counts(classify_documents(spark, sf_dir))


def top_categories(spark, sf_dir):
    """The eight commonest tags."""
    tagged = classify_documents(spark, sf_dir).select(L.redaction_tag(F.col("label")).alias("label"))
    return evaluate.category_counts(tagged, top=8)


def byte_char_offsets(spark, sf_dir):
    """Every entity's byte and code-point start and end."""
    found = Engine().classify(_read(spark, sf_dir, "documents")).select("doc_id", "text", F.explode("entities").alias("e"))
    return found.select("doc_id", "e.label", *_long("e.start", "e.end"), char_offset("text", "e.start").cast("long").alias("c_start"), char_offset("text", "e.end").cast("long").alias("c_end"))


def _whole(text: str, label: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit(1.0).alias("score"), F.lit(label).alias("label")))


def trim_spans(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Each turn between an equals sign and blanks as one span, trimmed."""
    t = _read(spark, sf_dir, table).withColumn("text", F.concat(F.lit("= \u3000"), "text", F.lit(" =\u3000 ")))
    return t.select(*keys, F.explode(post.trim("text", _whole("text", "secret"))).alias("s")).select(*keys, *_long("s.start", "s.end"))


def person_split(spark, sf_dir):
    """Each turn as a span of persons, split at separators and trimmed."""
    t = _read(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.explode(post.clean("text", _whole("text", "private_person"))).alias("s")).select("conv_id", "turn", *_long("s.start", "s.end"))


def merge_near_spans(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Words of five letters or more of each turn as spans; neighbours merge over up to four blanks."""
    return post.merged_rows(_read(spark, sf_dir, table), keys, "[A-Za-z]{5,}", L.REMAP["FIRSTNAME"])


def remap_labels(spark, sf_dir):
    """Entities by target label; labels without one are dropped."""
    e = classify_documents(spark, sf_dir)
    return evaluate.category_counts(e.join(F.broadcast(L.remap_table(spark)), "label").select(F.col("target").alias("label")))


def spans_from_bioes(spark, sf_dir):
    """Runs of equal event types of each user as a BIOES path, put together again; scores are mean values."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    starts, ends = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), ~F.col("event_type").eqNullSafe(F.lead("event_type").over(w))
    tag = F.when(F.col("event_type") == "view", "O").when(starts & ends, "S").when(starts, "B").when(ends, "E").otherwise("I")
    path = e.select("user_id", "event_id", F.col("event_type").alias("category"), tag.alias("tag"), F.col("value").alias("prob"))
    found = decode.spans_of_paths(path, "user_id", "event_id")
    return found.select("user_id", "category", F.col("tok_begin").alias("first_event"), F.col("tok_end").alias("last_event"), F.round("score", 6).alias("score"))


def threshold_filter(spark, sf_dir):
    """Of those spans the ones of a score of 50 or more."""
    return spans_from_bioes(spark, sf_dir).filter("score >= 50")


def argmax_label(spark, sf_dir):
    """The best class of each embedding read as logits."""
    return _read(spark, sf_dir, "embeddings").select("vec_id", windows.argmax("embedding").cast("long").alias("best"))


def log_softmax_rows(spark, sf_dir):
    """Log-probabilities of each embedding read as logits: the first and the greatest, rounded."""
    p = windows.log_softmax("embedding")
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(p[0], 6).alias("first"), F.round(F.array_max(p), 6).alias("best"))


def viterbi_paths(spark, sf_dir):
    """Embeddings of a label as the tokens of a document, decoded strictly."""
    e = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("tok_pos"), F.col("embedding").alias("logp"))
    return decode.decode_strict(e, L.label_table(WIDE_BIOES)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", *_long("s.cat", "s.tok_begin", "s.tok_end"), F.round("s.score", 4).alias("score"))


def lenient_decode(spark, sf_dir):
    """The same tokens by each one's best class and the forgiving reading; a token is one place wide."""
    e = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("tok_pos"), F.col("embedding").alias("logp"))
    best = decode.best_labels(e, L.label_table(WIDE_BIOES)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_pos", "label"))).alias("t"))
    rows = best.select("doc_id", F.transform("t", lambda x: x["label"]).alias("labels"), F.transform("t", lambda _, i: i).alias("starts"), F.transform("t", lambda _, i: i + 1).alias("ends"))
    return decode.decode_lenient(rows).select("doc_id", F.explode("spans").alias("s")).select("doc_id", *_long("s.start", "s.end"), "s.label")


def halo_windows(spark, sf_dir):
    """Windows of 4096 with a halo of 1024 over each document's characters."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.explode(windows.windows(F.char_length("text"))).alias("w"))
    return d.select("doc_id", *_long("w.start", "w.wlen", "w.lo", "w.hi"))


def window_coverage(spark, sf_dir):
    """Characters that windows own, a document: each comes once."""
    own = halo_windows(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"), F.min(F.col("start") + F.col("lo")).alias("first"), F.max(F.col("start") + F.col("hi")).alias("last"))
    return own


def pretokenize(spark, sf_dir):
    """Pre-tokens of each document: how many, and a digest of where they end."""
    p = F.col("p")
    d = _read(spark, sf_dir, "documents").select("doc_id", pretoken.pieces("text").alias("p"))
    return d.select("doc_id", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "\x1f").cast("binary")).alias("digest"))


def pretoken_spans(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Each turn's pre-tokens with byte offsets."""
    t = _read(spark, sf_dir, table).select(*keys, F.explode(pretoken.pretokens("text")).alias("p"))
    return t.select(*keys, *_long("p.start", "p.end"), "p.piece")


def pretoken_counts(spark, sf_dir):
    """Distinct pre-tokens of all documents and how often each comes."""
    d = _read(spark, sf_dir, "documents").select(F.explode(pretoken.pieces("text")).alias("piece"))
    return d.groupBy("piece").agg(F.count("*").alias("n"))


def digit_groups(spark, sf_dir):
    """Groups of up to three digits of each document."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pretoken.ALTERNATIVES[2]), F.lit(0))).cast("long").alias("n"))


def contraction_words(spark, sf_dir):
    """Words with an English contraction behind them, of each document."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[a-z]+(?i:'s|'t|'re|'ve|'m|'ll|'d)"), F.lit(0))).cast("long").alias("n"))


def _two_sides(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    side = lambda rules: d.select(F.col("doc_id").alias("row_no"), "text", F.transform(rule_spans("text", rules), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))).alias("spans"))
    return side(RULES), side(OTHER_RULES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.round(k, 9) for k in ("precision", "recall", "f1")})


def eval_by_label(spark, sf_dir):
    """One detector scored against another, by label."""
    return _rounded(evaluate.score(*_two_sides(spark, sf_dir)))


def eval_report(spark, sf_dir):
    """The same with totals and the labels' mean."""
    return _rounded(evaluate.report(*_two_sides(spark, sf_dir)))


def row_parity(spark, sf_dir):
    """Each embedding against itself rounded to two decimals."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("ref"))
    rows = evaluate.row_parity(e.withColumn("got", F.transform("ref", lambda x: F.round(x, 2))))
    return rows.select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("row_err", 6).alias("row_err"), "same_argmax")


def bioes_encode(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Classes of each turn's words under spans of its capitalised words and numbers."""
    spans = (("private_person", r"[A-Z][a-z]+(?: [a-z]+)?"), ("account_number", r"[0-9]+"))
    labels = ["O", *(f"{t}-{c}" for c, _ in spans for t in "BIES")]
    return datasets.class_rows(_read(spark, sf_dir, table), keys, r"[A-Za-z0-9]+", spans, labels)


def leakage_check(spark, sf_dir):
    """Documents that hold a passage of the benchmark."""
    return datasets.leaking(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id")


def without_benchmark(spark, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return datasets.without_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id")


def equal_to_benchmark(spark, sf_dir):
    """Documents whose whole text is a benchmark item's, and how many aren't: a row each."""
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return datasets.leaked(docs, items).agg(F.count("*").alias("equal")).crossJoin(datasets.without(docs, items).agg(F.count("*").alias("other")))


def benchmark_passages(spark, sf_dir):
    """Documents that hold a passage of a benchmark item, the item, and whether they hold all of it."""
    return datasets.passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def without_benchmark_passages(spark, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return datasets.without_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id")


def repeated_texts(spark, sf_dir):
    """Texts that more than one document has."""
    return datasets.repeated_texts(_read(spark, sf_dir, "documents"))


def repeated_text_ids(spark, sf_dir):
    """Each document whose text another one has too, with the text's hash."""
    return datasets.repeated_ids(_read(spark, sf_dir, "documents"))


def validation_split(spark, sf_dir):
    """A tenth of the documents, exactly, by a seeded hash."""
    return datasets.with_exact_split(_read(spark, sf_dir, "documents"), 0.1, seed=7, id_col="doc_id").select("doc_id", "is_validation")


def lang_rollup(spark, sf_dir):
    """Labelled documents by language and in all: how many, of good quality, and toxic."""
    d, l = _read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels")  # noqa: E741
    sums = [F.count("*").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")]
    return d.join(l, "doc_id").rollup("lang").agg(*sums, F.grouping("lang").cast("int").alias("is_total")).select("lang", "is_total", *(F.col(k).cast("long").alias(k) for k in ("labelled", "good", "toxic")))


def wrapped_lines(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Each turn wrapped at 40 characters, with the entities on each line."""
    return present.line_rows(_read(spark, sf_dir, table), keys, rule_spans("text", unit="chars"), 40)


def found_so_far(spark, sf_dir):
    """Entities found up to each one's end, in its document."""
    return present.found_so_far(classify_documents(spark, sf_dir))


def latest_findings(spark, sf_dir):
    """The three last entities of each document."""
    return present.latest(classify_documents(spark, sf_dir), 3).withColumn("rank", F.col("rank").cast("long"))


def entities_json(spark, sf_dir):
    """Each document's entities as JSON."""
    return Engine().classify(_read(spark, sf_dir, "documents")).select("doc_id", sinks.entities_json("text", "entities").alias("json"))


def redact_pages(spark, sf_dir):
    """Pages without their tags, entities as tags in brackets."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return Engine().redact(p, "page_id", labels=True).select("page_id", "redacted")


def redact_conversations(spark, sf_dir):
    """Turns with entities as tags."""
    return Engine().redact(_read(spark, sf_dir, "conversations"), "conv_id", labels=True).select("conv_id", "turn", "redacted")


def stream_redact(spark, sf_dir):
    """Documents read as a stream, redacted by tags, written and read again."""
    path = _shared(spark)
    docs = _read(spark, sf_dir, "documents")
    import os

    source = f"{sf_dir}/documents.parquet"
    glob = source if os.path.isdir(source) else f"{sf_dir}/documents*.parquet"
    run_once(redact_stream(read_documents(spark, glob, docs.schema), labels=True).select("doc_id", "redacted"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def tokenize_bpe(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Tokens of each turn under a public vocabulary."""
    return bpe.token_rows(_read(spark, sf_dir, table), bpe.load_tokenizer_json(VOCABULARY), keys)


def _tiny() -> Engine:
    config = Config(2, 16, 2, 1, 8, 8, 4, 2, 4, 4096, 4096, len(BIOES))
    vocabulary = bpe.Vocabulary({bytes([b]): b for b in range(256)}, {})

    def load(kept={}):  # noqa: B006
        if not kept:
            kept |= random_weights(config, 256, seed=3)
        return kept

    return Engine(vocabulary=vocabulary, config=config, load=load, labels=BIOES, window=64, threshold=0.0)


def classify_by_model(spark, sf_dir, table="conversations", keys=("conv_id", "turn")):
    """Turns classified by a small model of seeded weights: tokens, windows, forward pass, decoding, clean-up."""
    t = _read(spark, sf_dir, table).select((F.col(*keys) if len(keys) == 1 else F.concat_ws("-", *keys)).alias("doc_id"), "text")
    return _tiny().entity_rows(t).select("doc_id", "start", "end", "label", F.round(F.col("score").cast("float"), 3).alias("score"))


def _of_documents(query):
    """The query over documents, whose texts are the long ones, and not turns."""

    def run(spark, sf_dir):
        return query(spark, sf_dir, "documents", ("doc_id",))

    run.__name__, run.__doc__ = f"{query.__name__}_documents", f"{query.__name__} over documents, not turns."
    return run


_ALL = (
    classify_documents, redact_fixed, redact_labels, mask_documents, entity_counts, top_categories, byte_char_offsets, trim_spans, person_split, merge_near_spans, remap_labels,
    spans_from_bioes, threshold_filter, argmax_label, log_softmax_rows, viterbi_paths, lenient_decode, halo_windows, window_coverage, pretokenize, pretoken_spans, pretoken_counts,
    digit_groups, contraction_words, eval_by_label, eval_report, row_parity, bioes_encode, leakage_check, without_benchmark, equal_to_benchmark, benchmark_passages, without_benchmark_passages, repeated_texts, repeated_text_ids, validation_split, lang_rollup, wrapped_lines,
    found_so_far, latest_findings, entities_json, redact_pages, redact_conversations, stream_redact, tokenize_bpe, classify_by_model,
    *map(_of_documents, (trim_spans, merge_near_spans, pretoken_spans, bioes_encode, wrapped_lines, tokenize_bpe, classify_by_model)),
)
QUERIES = {f.__name__: f for f in _ALL}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _match_sql(table: str, keys: str, label: str, pattern: str, size: str, text: str = "text") -> str:
    """Matches as rows: what lies between them and they themselves part the text."""
    p = _quoted(pattern)
    return f"""SELECT {keys}, {_quoted(label)} AS label, CAST(sum({size}(g) + {size}(m)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) - {size}(m) AS s,
 CAST(sum({size}(g) + {size}(m)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS e
FROM (SELECT {keys}, unnest(regexp_extract_all({text}, {p})) AS m, unnest(regexp_split_to_array({text}, {p})[:-2]) AS g, unnest(range(len(regexp_extract_all({text}, {p})))) AS i
 FROM {table} WHERE regexp_matches({text}, {p}))"""


def _rules_sql(table: str, keys: str, size: str = "strlen", rules=RULES) -> str:
    return "\nUNION ALL ".join(_match_sql(table, keys, k, p, size) for k, p in rules)


def _case_sql(column: str, values: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {_quoted(k)} THEN {_quoted(v)}" for k, v in sorted(values.items())) + f" ELSE {other} END"


def _redact_sql(table: str, keys: str, stands: str, out: str = "redacted") -> str:
    """The sweep as windows: a span stays if it ends behind all before it."""
    on = " AND ".join(f"d.{k} = x.{k}" for k in keys.split(", "))
    return f"""
WITH m AS ({_rules_sql(table, keys, "length")}),
v AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM m),
k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s, e DESC, label), 0) AS f FROM v WHERE past IS NULL OR e > past),
x AS (SELECT d.{keys.replace(", ", ", d.")}, string_agg(CASE WHEN s > f THEN substring(text, f + 1, s - f) ELSE '' END || {stands}, '' ORDER BY s, e) AS t, max(e) AS last
      FROM k x JOIN {table} d ON {on} GROUP BY ALL)
SELECT d.{keys.replace(", ", ", d.")}, CASE WHEN x.t IS NULL THEN text ELSE x.t || substring(text, last + 1) END AS {out}
FROM {table} d LEFT JOIN x ON {on}"""


_TAG = _case_sql("label", L.REDACTION_TAGS, _quoted(L.OTHER_TAG))
_TURNS = "conversations"
_SPACE = re.sub(r"\\x\{([0-9a-f]+)\}", r"\\x{\1}", pretoken.SPACE)
_INNER = _SPACE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}\x{c}")
#: RE2 has no look-ahead: a mark that no text holds parts a run of blanks before its last one, and is taken out again.
_MARK = "\U0010fffd"
_MARKED_PATTERN = "|".join(
    (
        rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?{pretoken.UPPER}*{pretoken.LOWER}+{pretoken.SUFFIX}",
        rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?{pretoken.UPPER}+{pretoken.LOWER}*{pretoken.SUFFIX}",
        r"\p{N}{1,3}",
        rf" ?[^{_SPACE}\p{{L}}\p{{N}}{_MARK}]+[\r\n/]*",
        rf"[{_SPACE}]*[\r\n]+",
        rf"[{_SPACE}]+",
        _MARK,
    )
)
_PIECES = f"list_filter(regexp_extract_all(regexp_replace(text, {_quoted(f'([{_INNER}])([{_INNER}][^{_SPACE}])')}, '\\1{_MARK}\\2', 'g'), {_quoted(_MARKED_PATTERN)}), lambda p: p <> '{_MARK}')"
_EDGE = r"\x{0}-\x{20}\x{3000}"


def _trimmed(x: str, s: str) -> str:
    """(start, end) of a trimmed part that begins at byte s."""
    return f"{s} + strlen(regexp_extract({x}, '^[{_EDGE}=]*')) AS \"start\", {s} + strlen({x}) - strlen(regexp_extract({x}, '[{_EDGE}]*$')) AS \"end\""


_SEPARATORS = post.PERSON_SEPARATORS
_SPANS_SQL = """
WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
             - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT * FROM (SELECT user_id, event_type AS category, min(event_id) AS first_event, max(event_id) AS last_event, round(avg(value), 6) AS score
FROM e WHERE event_type <> 'view' GROUP BY user_id, event_type, g)"""
_EVAL_CTES = f"""
WITH gold AS (SELECT DISTINCT doc_id, s, e, label FROM ({_rules_sql("documents", "doc_id")})),
pred AS (SELECT DISTINCT doc_id, s, e, label FROM ({_rules_sql("documents", "doc_id", rules=OTHER_RULES)})),
tp AS (FROM gold INTERSECT FROM pred), fn AS (FROM gold EXCEPT FROM pred), fp AS (FROM pred EXCEPT FROM gold),
pt AS (SELECT * FROM fn SEMI JOIN fp ON fn.doc_id = fp.doc_id AND fn.label = fp.label AND fn.s < fp.e AND fp.s < fn.e),
c AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(p)::BIGINT AS partial FROM (
  SELECT label, 1 AS tp, 0 AS fp, 0 AS fn, 0 AS p FROM tp UNION ALL SELECT label, 0, 1, 0, 0 FROM fp
  UNION ALL SELECT label, 0, 0, 1, 0 FROM fn UNION ALL SELECT label, 0, 0, 0, 1 FROM pt) GROUP BY label),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c)
"""
_BY_LABEL = 'SELECT label, tp, fp, fn, partial, round(p, 9) AS "precision", round(rc, 9) AS recall, round(f, 9) AS f1 FROM r'
_WORDS = "conv_id, turn"
_BIOES_SQL = f"""
WITH w AS (SELECT conv_id, turn, s, e, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s) - 1 AS pos FROM ({_match_sql(_TURNS, _WORDS, "w", "[A-Za-z0-9]+", "length")})),
sp AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY label DESC, s) AS k, s AS a, e AS b FROM (
  {_match_sql(_TURNS, _WORDS, "private_person", "[A-Z][a-z]+(?: [a-z]+)?", "length")} UNION ALL {_match_sql(_TURNS, _WORDS, "account_number", "[0-9]+", "length")})),
h AS (SELECT w.conv_id, w.turn, w.pos, sp.k, sp.label, min(w.pos) OVER q AS first, max(w.pos) OVER q AS last
      FROM w JOIN sp ON w.conv_id = sp.conv_id AND w.turn = sp.turn AND w.s < sp.b AND sp.a < w.e WINDOW q AS (PARTITION BY w.conv_id, w.turn, sp.k)),
l AS (SELECT conv_id, turn, pos, arg_max(CASE WHEN label = 'account_number' THEN 4 ELSE 0 END + CASE WHEN first = last THEN 4 WHEN pos = last THEN 3 WHEN pos = first THEN 1 ELSE 2 END, k) AS c FROM h GROUP BY ALL)
SELECT w.conv_id, w.turn, w.pos, coalesce(l.c, 0)::BIGINT AS "class" FROM w LEFT JOIN l ON w.conv_id = l.conv_id AND w.turn = l.turn AND w.pos = l.pos"""
_PASSAGE_WORDS = "regexp_extract_all(regexp_replace(lower(text), '([" + "".join(rf"\p{{{x}}}" for x in datasets.UNSPACED) + r"])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}_]+')"
_PASSAGE_RUNS = "unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
_PASSAGES_SQL = f"""
WITH b AS (SELECT *, least(len(w), {datasets.PASSAGE_WORDS}) AS k FROM (SELECT item_id, text, {_PASSAGE_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, text, {_PASSAGE_WORDS} AS w FROM documents),
x AS (SELECT item_id, {_PASSAGE_RUNS} AS g FROM b), y AS (SELECT doc_id, {_PASSAGE_RUNS} AS g FROM d, (SELECT DISTINCT k FROM b)),
p AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y ON x.g = y.g)
SELECT p.doc_id, p.item_id, contains(d.text, b.text) AS whole FROM p JOIN d ON p.doc_id = d.doc_id JOIN b ON p.item_id = b.item_id"""
_WINDOWS_SQL = """
WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, n, unnest(range(CASE WHEN n <= 4096 THEN 1 ELSE CAST(ceil((n - 4096) / 2048.0) AS BIGINT) + 1 END)) * 2048 AS s FROM n)
SELECT doc_id, s AS "start", least(4096, n - s) AS wlen, CASE WHEN s = 0 THEN 0 ELSE 1024 END::BIGINT AS lo, CASE WHEN s + 4096 >= n THEN n - s ELSE 3072 END AS hi FROM k"""
#: Of the class c, from 1: whether a label of its own may begin there; the scores of its category's B and I; the best closed class.
_FRESH, _B, _I = "(c = 1 OR (c - 2) % 4 IN (0, 3))", "s[2 + (c - 2) // 4 * 4]", "s[3 + (c - 2) // 4 * 4]"
_CLOSED = "list_filter(range(1, 65), lambda c: c = 1 OR (c - 2) % 4 IN (2, 3))"
_BEST = f"{_CLOSED}[list_position(list_transform({_CLOSED}, lambda c: s[c]), list_max(list_transform({_CLOSED}, lambda c: s[c])))]"
#: Byte-pair encoding of each distinct pre-token by a recursion: of all neighbours that may merge the pair of the least rank, the leftmost, merges.
_ALPHABET = _quoted("".join(sorted(bpe.byte_alphabet(), key=bpe.byte_alphabet().get)))
_BYTE = "('0x' || substring(h, 2 * i + 1, 2))::INT"
_BPE_SQL = f"""
WITH RECURSIVE v AS (SELECT part, id::BIGINT AS id FROM (SELECT unnest(json_keys(content, '$.model.vocab')) AS part, unnest(json_extract(content, '$.model.vocab.*')) AS id FROM read_text('{VOCABULARY}'))),
m AS (SELECT unnest(json_extract_string(content, '$.model.merges[*][0]')) AS a, unnest(json_extract_string(content, '$.model.merges[*][1]')) AS b,
        unnest(range(json_array_length(content, '$.model.merges')::BIGINT)) AS rank FROM read_text('{VOCABULARY}')),
o AS (SELECT conv_id, turn, piece, CAST(sum(strlen(piece)) OVER (PARTITION BY conv_id, turn ORDER BY k) AS BIGINT) - strlen(piece) AS at0
  FROM (SELECT conv_id, turn, unnest(p) AS piece, unnest(range(len(p))) AS k FROM (SELECT conv_id, turn, {_PIECES} AS p FROM conversations))),
d AS (SELECT piece, h, list_transform(range(0, strlen(piece)), lambda i: substring({_ALPHABET}, {_BYTE} + 1, 1)) AS c FROM (SELECT piece, hex(encode(piece)) AS h FROM (SELECT DISTINCT piece FROM o))),
r AS (
  SELECT piece, CASE WHEN v.part IS NULL THEN c ELSE [v.part] END AS parts, 0 AS step FROM d LEFT JOIN v ON v.part = array_to_string(c, '')
  UNION ALL
  SELECT piece, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:], step + 1
  FROM (SELECT piece, any_value(parts) AS parts, any_value(step) AS step, arg_min(i, rank * 1000000 + i) AS i
        FROM (SELECT piece, parts, step, unnest(range(1, len(parts))) AS i FROM r WHERE len(parts) > 1) q JOIN m ON m.a = q.parts[q.i] AND m.b = q.parts[q.i + 1] GROUP BY piece)),
l AS (SELECT piece, arg_max(parts, step) AS parts FROM r GROUP BY piece),
e AS (SELECT piece, part, CAST(sum(length(part)) OVER (PARTITION BY piece ORDER BY k) AS BIGINT) AS b, length(part) AS n FROM (SELECT piece, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM l)),
w AS (SELECT piece, list_filter(range(0, strlen(piece) + 1), lambda i: i = 0 OR i = strlen(piece) OR substring(h, 2 * i + 1, 1) NOT IN ('8', '9', 'A', 'B')) AS whole FROM d),
t AS (SELECT e.piece, coalesce(v.id, 0) AS id, list_max(list_filter(whole, lambda x: x <= b - n)) AS s, list_min(list_filter(whole, lambda x: x >= b)) AS x FROM e JOIN w ON w.piece = e.piece LEFT JOIN v ON v.part = e.part)
SELECT conv_id, turn, id, at0 + s AS "start", at0 + x AS "end" FROM o JOIN t ON t.piece = o.piece"""
_ENTITIES_SQL = f'SELECT doc_id, s AS "start", e AS "end", label FROM ({_rules_sql("documents", "doc_id")})'

ORACLE_SQL: dict[str, str] = {
    "classify_documents": _ENTITIES_SQL,
    "redact_fixed": _redact_sql("documents", "doc_id", "'***'"),
    "redact_labels": _redact_sql("documents", "doc_id", _TAG),
    "stream_redact": _redact_sql("documents", "doc_id", _TAG),
    "mask_documents": _redact_sql("documents", "doc_id", "repeat('█', e - greatest(s, f))", "masked"),
    "redact_conversations": _redact_sql(_TURNS, "conv_id, turn", _TAG),
    "redact_pages": "WITH " + "pg AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages), " + _redact_sql("pg", "page_id", _TAG).lstrip()[5:],
    "entity_counts": f"SELECT label, count(*) AS n FROM ({_ENTITIES_SQL}) GROUP BY label",
    "top_categories": f"SELECT {_TAG} AS label, count(*) AS n FROM ({_ENTITIES_SQL}) GROUP BY 1 ORDER BY n DESC, label LIMIT 8",
    "remap_labels": f"SELECT label, count(*) AS n FROM (SELECT {_case_sql('label', L.REMAP, 'NULL')} AS label FROM ({_ENTITIES_SQL})) WHERE label IS NOT NULL GROUP BY label",
    "byte_char_offsets": 'SELECT b.doc_id, b.label, b.s AS "start", b.e AS "end", c.s AS c_start, c.e AS c_end FROM '
    + " JOIN ".join(f"(SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY s) AS k FROM ({_rules_sql('documents', 'doc_id', size)})) {name}" for size, name in (("strlen", "b"), ("length", "c")))
    + " ON b.doc_id = c.doc_id AND b.label = c.label AND b.k = c.k",
    "found_so_far": f'SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY "end") AS found FROM ({_ENTITIES_SQL})',
    "latest_findings": f'SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start" DESC, "end" DESC, label) AS rank FROM ({_ENTITIES_SQL}) QUALIFY rank <= 3',
    "trim_spans": f"""SELECT conv_id, turn, "start", "end" FROM (SELECT conv_id, turn, {_trimmed("t", "0")} FROM (SELECT *, '= \u3000' || text || ' =\u3000 ' AS t FROM conversations)) WHERE "start" < "end" """,
    "person_split": f"""
WITH r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^{_SEPARATORS}]+|[{_SEPARATORS}]+')) AS x, unnest(range(len(regexp_extract_all(text, '[^{_SEPARATORS}]+|[{_SEPARATORS}]+')))) AS i FROM conversations),
o AS (SELECT *, CAST(sum(strlen(x)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) - strlen(x) AS p0 FROM r)
SELECT conv_id, turn, "start", "end" FROM (SELECT conv_id, turn, {_trimmed("x", "p0")} FROM o WHERE NOT regexp_matches(x, '^[{_SEPARATORS}]')) WHERE "start" < "end" """,
    "merge_near_spans": f"""
WITH m AS ({_match_sql(_TURNS, _WORDS, "private_person", "[A-Za-z]{5,}", "length")}),
g AS (SELECT m.*, lag(e) OVER (PARTITION BY conv_id, turn ORDER BY s) AS p FROM m),
n AS (SELECT g.*, sum(CASE WHEN p IS NOT NULL AND s - p <= 4 AND trim(substring(text, p + 1, s - p), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY g.conv_id, g.turn ORDER BY s) AS grp
      FROM g JOIN conversations c ON g.conv_id = c.conv_id AND g.turn = c.turn)
SELECT conv_id, turn, min(s) AS "start", max(e) AS "end", label FROM n GROUP BY conv_id, turn, grp, label""",
    "spans_from_bioes": _SPANS_SQL,
    "threshold_filter": _SPANS_SQL + " WHERE score >= 50",
    "argmax_label": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings",
    "log_softmax_rows": """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding)::DOUBLE AS m FROM embeddings),
s AS (SELECT *, ln(list_sum(list_transform(v, lambda a: exp(a - m)))) AS z FROM x)
SELECT vec_id, round(v[1] - m - z, 6) AS first, round(-z, 6) AS best FROM s""",
    "halo_windows": _WINDOWS_SQL,
    "window_coverage": "SELECT doc_id, length(text) AS covered, 0::BIGINT AS first, length(text) AS last FROM documents WHERE text IS NOT NULL",
    "pretokenize": f"SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, chr(31))) AS digest FROM (SELECT doc_id, {_PIECES} AS p FROM documents)",
    "pretoken_counts": f"SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece",
    "pretoken_spans": f"""
SELECT conv_id, turn, CAST(sum(strlen(piece)) OVER w AS BIGINT) - strlen(piece) AS "start", CAST(sum(strlen(piece)) OVER w AS BIGINT) AS "end", piece
FROM (SELECT conv_id, turn, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT conv_id, turn, {_PIECES} AS p FROM conversations)) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)""",
    "digit_groups": r"SELECT doc_id, len(regexp_extract_all(text, '\p{N}{1,3}'))::BIGINT AS n FROM documents",
    "contraction_words": r"SELECT doc_id, len(regexp_extract_all(text, '[a-z]+(?i:''s|''t|''re|''ve|''m|''ll|''d)'))::BIGINT AS n FROM documents",
    "eval_by_label": _EVAL_CTES + _BY_LABEL,
    "eval_report": _EVAL_CTES + ", t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(partial)::BIGINT AS partial, avg(p) AS p, avg(rc) AS rc, avg(f) AS f FROM r)\n" + _BY_LABEL
    + " UNION ALL SELECT 'micro', tp, fp, fn, partial, round(tp / nullif(tp + fp, 0), 9), round(tp / nullif(tp + fn, 0), 9), round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) FROM t UNION ALL SELECT 'macro', tp, fp, fn, partial, round(p, 9), round(rc, 9), round(f, 9) FROM t",
    "row_parity": """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda v: round(v, 2)) AS b FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / list_max(list_transform(a, lambda v: abs(v))), 6) AS row_err,
  list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same_argmax FROM x""",
    "bioes_encode": _BIOES_SQL,
    "leakage_check": f"SELECT DISTINCT doc_id FROM ({_PASSAGES_SQL})",
    "without_benchmark": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_PASSAGES_SQL}))",
    "equal_to_benchmark": 'SELECT count(*) FILTER (text IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) AS "equal", count(*) FILTER (text IS NULL OR text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) AS other FROM documents',
    "lang_rollup": "SELECT lang, grouping(lang)::INTEGER AS is_total, count(*) AS labelled, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "wrapped_lines": f"""
WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS rest, unnest(range(len(string_split(text, chr(10))))) AS k FROM conversations),
q AS (SELECT conv_id, turn, k, rest, CAST(sum(length(rest) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) AS BIGINT) - length(rest) - 1 AS o FROM p),
w AS (
  SELECT conv_id, turn, k, 0 AS j, o AS "start", rest, NULL::BIGINT AS "end", NULL::BIGINT AS past FROM q
  UNION ALL
  SELECT conv_id, turn, k, j + 1, "start" + past, substring(rest, past + 1), NULL, NULL FROM (
    SELECT conv_id, turn, k, j, "start", rest, CASE WHEN b > 0 THEN b + 1 ELSE 40 END AS past FROM (
      SELECT *, CASE WHEN instr(reverse(substring(rest, 1, 41)), ' ') > 0 THEN 41 - instr(reverse(substring(rest, 1, 41)), ' ') ELSE 0 END AS b FROM w WHERE length(rest) > 40))),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, j) - 1 AS line, "start",
        "start" + CASE WHEN length(rest) <= 40 THEN length(rest) WHEN instr(reverse(substring(rest, 1, 41)), ' ') BETWEEN 1 AND 40 THEN 41 - instr(reverse(substring(rest, 1, 41)), ' ') ELSE 40 END AS "end" FROM w),
m AS ({_rules_sql(_TURNS, "conv_id, turn", "length")})
SELECT l.conv_id, l.turn, l.line, l."start", l."end", count(m.s) AS entities FROM l LEFT JOIN m ON l.conv_id = m.conv_id AND l.turn = m.turn AND m.s < l."end" AND l."start" < m.e GROUP BY ALL""",
    "tokenize_bpe": _BPE_SQL,
    "validation_split": """SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) <= CAST(floor(count(*) OVER () * 0.1) AS BIGINT) AS is_validation FROM documents""",
    "entities_json": f"""
WITH e AS ({" UNION ALL ".join(f"SELECT {k} AS rule, * FROM ({_match_sql('documents', 'doc_id', label, pattern, 'strlen')})" for k, (label, pattern) in enumerate(RULES))}),
j AS (SELECT e.doc_id, string_agg('{{"entity_group":' || to_json(label) || ',"start":' || s || ',"end":' || e || ',"score":1.0,"text":' || to_json(decode(encode(text)[s + 1:e])) || '}}', ',' ORDER BY rule, s) AS j FROM e JOIN documents d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN '[' || coalesce(j, '') || ']' END AS json FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id""",
    "viterbi_paths": f"""
WITH RECURSIVE t AS (SELECT label AS d, vec_id, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
v AS (
  SELECT d, t, list_transform(range(1, 65), lambda c: CASE WHEN {_FRESH} THEN e[c] ELSE '-inf'::FLOAT END) AS s, NULL::BIGINT[] AS back FROM t WHERE t = 1
  UNION ALL
  SELECT d, t, list_transform(range(1, 65), lambda c: CASE WHEN {_FRESH} THEN s[best] ELSE greatest({_B}, {_I}) END + e[c]),
    list_transform(range(1, 65), lambda c: CASE WHEN {_FRESH} THEN best WHEN {_I} > {_B} THEN 3 + (c - 2) // 4 * 4 ELSE 2 + (c - 2) // 4 * 4 END)
  FROM (SELECT t.d, t.t, t.e, v.s, {_BEST} AS best FROM v JOIN t ON t.d = v.d AND t.t = v.t + 1)),
p AS (
  SELECT v.d, v.t, {_BEST} AS c, back FROM v JOIN t ON t.d = v.d AND t.t = v.t AND t.t = t.n
  UNION ALL
  SELECT v.d, v.t, p.back[p.c], v.back FROM p JOIN v ON v.d = p.d AND v.t = p.t - 1),
w AS (SELECT p.d, t.vec_id, p.t, p.c, exp(t.e[p.c]::DOUBLE)::FLOAT::DOUBLE AS prob, sum(CASE WHEN p.c > 1 AND (p.c - 2) % 4 IN (0, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY p.d ORDER BY p.t) AS g FROM p JOIN t ON t.d = p.d AND t.t = p.t)
SELECT d AS doc_id, min((c - 2) // 4)::BIGINT AS cat, min(t)::BIGINT - 1 AS tok_begin, max(t)::BIGINT - 1 AS tok_end, round(avg(prob)::FLOAT, 4) AS score FROM w WHERE c > 1 GROUP BY d, g""",
    "lenient_decode": """
WITH RECURSIVE b AS (SELECT label AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_position(embedding, list_max(embedding)) AS c FROM embeddings),
k AS (SELECT d, t, CASE WHEN c = 1 THEN 'O' ELSE substring('BIES', CAST((c - 2) % 4 AS INT) + 1, 1) END AS tag, 'C' || ((c - 2) // 4) AS name FROM b),
r AS (
  SELECT d, -1::BIGINT AS t, NULL::VARCHAR AS cat, 0::BIGINT AS first, [] :: STRUCT("start" BIGINT, "end" BIGINT, label VARCHAR)[] AS made FROM k GROUP BY d
  UNION ALL
  SELECT k.d, k.t,
    CASE WHEN tag IN ('I', 'E') AND cat = name THEN CASE tag WHEN 'I' THEN cat END WHEN tag IN ('O', 'S') THEN NULL ELSE name END,
    CASE WHEN tag IN ('I', 'E') AND cat = name THEN first ELSE k.t END,
    CASE WHEN tag IN ('I', 'E') AND cat = name THEN CASE tag WHEN 'E' THEN [{'start': first, 'end': k.t + 1, 'label': cat}] ELSE [] END
      ELSE CASE WHEN cat IS NULL THEN [] ELSE [{'start': first, 'end': k.t, 'label': cat}] END || CASE tag WHEN 'S' THEN [{'start': k.t, 'end': k.t + 1, 'label': name}] ELSE [] END END
  FROM r JOIN k ON k.d = r.d AND k.t = r.t + 1),
l AS (SELECT d, first, max(t) OVER (PARTITION BY d) AS last, t, cat FROM r)
SELECT d AS doc_id, m."start", m."end", m.label FROM (SELECT d, unnest(made) AS m FROM r)
UNION ALL SELECT d, first, last + 1, cat FROM l WHERE t = last AND cat IS NOT NULL""",
    "benchmark_passages": _PASSAGES_SQL,
    "without_benchmark_passages": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_PASSAGES_SQL}))",
    "repeated_texts": "SELECT sha256(text) AS text_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "repeated_text_ids": "SELECT sha256(text) AS text_hash, count(*) OVER (PARTITION BY text) AS n, doc_id FROM documents WHERE text IS NOT NULL QUALIFY n > 1",
}
for _name in ("trim_spans", "merge_near_spans", "pretoken_spans", "bioes_encode", "wrapped_lines", "tokenize_bpe"):
    ORACLE_SQL[f"{_name}_documents"] = f"WITH conversations AS (SELECT doc_id AS conv_id, 0 AS turn, text FROM documents) SELECT conv_id AS doc_id, * EXCLUDE (conv_id, turn) FROM ({ORACLE_SQL[_name]})"
