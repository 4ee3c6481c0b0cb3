"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import audio, chatformat, gridjoin, langid, mixing, ngramjoin, packing, pii, tokencount, toxicity
from spanloom.llm.store import bounded_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its group and the number of documents of a trigram similarity of 0.5 or more."""
    return ngramjoin.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from a bounded sample of the table's own labels."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its private spans redacted."""
    return pii.redact_pii(_read(spark, sf_dir, "documents"), pii.fit())


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes read as a telephone recording, the codec by its id: no table has audio of its own."""
    from pyspark.sql import functions as F

    codec = F.element_at(F.array(*map(F.lit, audio.CODECS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"), codec.alias("codec"))
    return audio.decode_telephony(rows, id_col="doc_id")


def op6_embedding_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with the least id of its group and the number of embeddings within 0.25."""
    return gridjoin.embedding_near_join(_read(spark, sf_dir, "embeddings"))


def op6_embedding_near_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 1.1, as the small tables hold no embeddings that are nearer than 0.89."""
    return gridjoin.embedding_near_join(_read(spark, sf_dir, "embeddings"), 1.1)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered and read back."""
    return chatformat.format_chats(_read(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document, learned from all labels."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_on(docs, _read(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in windows of 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in training order, from the sources' own shares to flatter ones."""
    from pyspark.sql import functions as F

    return mixing.mix_sources(_read(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


def op10_mixing_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents weighed by their tokens, not by an estimate from their bytes; n_tokens is one more column."""
    from pyspark.sql import functions as F

    docs = tokencount.with_tokens(_read(spark, sf_dir, "documents"))
    return mixing.mix_sources(docs, tokens_col="n_tokens").withColumn("position", F.round("position", 9))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard_join, op3_language_id, op4_pii, op5_telephony_audio, op6_embedding_near_pairs, op6_embedding_near_wide, op7_chat_format, op8_toxicity, op9_packing, op10_mixing, op10_mixing_by_tokens)}

_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: RE2 has no look-ahead: a mark that no text holds parts a run of blanks before its last one, and is taken out again.
_MARK = "\U0010fffd"
_PIECES = rf"""list_filter(regexp_extract_all(regexp_replace(text, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\1{_MARK}\2', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}{_MARK}]+|[{_SPACE}]+|{_MARK}'), lambda p: p <> '{_MARK}')"""
#: Each distinct pre-token, as the hexadecimal digits of its bytes, is merged by a recursion: of all neighbours the pair of the least rank, the leftmost.
_TOKENS = f"""
WITH RECURSIVE v AS (SELECT hex(from_base64(string_split(x, ' ')[1])) AS part, string_split(x, ' ')[2]::BIGINT AS rank
  FROM (SELECT unnest(string_split(content, chr(10))) AS x FROM read_text('{tokencount.DEFAULT_RANKS}')) WHERE x <> ''),
o AS (SELECT doc_id, hex(encode(p)) AS piece FROM (SELECT doc_id, unnest({_PIECES}) AS p FROM documents)),
r AS (
  SELECT piece, CASE WHEN v.part IS NULL THEN list_transform(range(0, length(piece) // 2), lambda i: substring(piece, 2 * i + 1, 2)) ELSE [piece] END AS parts, 0 AS step
  FROM (SELECT DISTINCT piece FROM o) LEFT JOIN v ON v.part = piece
  UNION ALL
  SELECT piece, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:], step + 1
  FROM (SELECT piece, any_value(parts) AS parts, any_value(step) AS step, arg_min(i, rank * 1000000 + i) AS i
        FROM (SELECT piece, parts, step, unnest(range(1, len(parts))) AS i FROM r WHERE len(parts) > 1) q JOIN v ON v.part = q.parts[q.i] || q.parts[q.i + 1] GROUP BY piece)),
n AS (SELECT piece, min(len(parts)) AS n FROM r GROUP BY piece),
c AS (SELECT doc_id, sum(n)::BIGINT AS n FROM o JOIN n ON o.piece = n.piece GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(n, 0) END AS n_tokens FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id"""

_NEAR = """
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {}),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, coalesce(n, 0) AS n_links
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_token_counts": _TOKENS,
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
      FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS o
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT doc_a, doc_b FROM o WHERE o >= 0.5 * (na + nb - o)),
r AS (SELECT DISTINCT doc_a AS a, doc_a AS b FROM l UNION SELECT r.a, l.doc_b FROM r JOIN l ON r.b = l.doc_a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT doc_a, count(*) AS n FROM l GROUP BY doc_a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN k ON k.doc_a = doc_id
""",
    "op6_embedding_near_pairs": _NEAR.format(0.25),
    "op6_embedding_near_wide": _NEAR.format(1.1),
    "op7_chat_format": r"""
SELECT conv_id, count(*) AS n_turns, sum(CASE WHEN regexp_matches(text, '<\\*\|') THEN 1 ELSE 0 END)::BIGINT AS n_escaped,
  string_agg('<|' || role || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM conversations GROUP BY conv_id
""",
    "op10_mixing": """
WITH d AS (SELECT *, coalesce(source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS o,
             coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0) AS n FROM documents),
t AS (SELECT s, CAST(sum(n) AS BIGINT) AS supply FROM d GROUP BY s),
a AS (SELECT CAST(sum(supply) AS DOUBLE) AS total, sum(sqrt(supply / (SELECT sum(supply)::DOUBLE FROM t))) AS z FROM t),
-- weights run straight from u, the source's own share, to v
w AS (SELECT s, supply, total, supply / total AS u, sqrt(supply / total) / z AS v FROM t, a WHERE supply > 0),
c AS (SELECT d.*, w.supply, w.total, w.u, w.v, (w.u + w.v) / 2 * w.total AS demand,
        coalesce(sum(n) OVER (PARTITION BY d.s ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM d JOIN w ON d.s = w.s),
k AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((demand - c) / supply) AS BIGINT)))) AS epoch FROM c WHERE c < demand),
x AS (SELECT *, (c + epoch * supply) / total AS q FROM k WHERE c + epoch * supply < demand)
SELECT doc_id, text, lang, source, n_chars,
  round(least(coalesce(2 * q / nullif(u + sqrt(greatest(u * u + 2 * (v - u) * q, 0)), 0), 0), 1), 9) AS position, epoch
FROM x
""",
}
_ESTIMATE = "coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0)"
ORACLE_SQL["op10_mixing_by_tokens"] = f"WITH counted AS (SELECT documents.*, k.n_tokens FROM documents JOIN ({_TOKENS}) k ON k.doc_id = documents.doc_id),\n" + ORACLE_SQL["op10_mixing"].strip().removeprefix("WITH ").replace(_ESTIMATE, "coalesce(n_tokens, 0)").replace("FROM documents", "FROM counted").replace("SELECT doc_id, text, lang, source, n_chars,", "SELECT doc_id, text, lang, source, n_chars, n_tokens,")
