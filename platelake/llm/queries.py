"""The numbered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake.llm import (chat, crosstok, langid, mixing, mtree, neardup, packing, quality, sharding, spotsigs, toxicity,
                           urls, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, F.coalesce(id_fold(5) != 0, F.lit(False)))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(id_fold(5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op5_minhash_near_dedup"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) m ON s.doc_id = m.u
"""


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"), F.coalesce(id_fold(3) != 1, F.lit(False)))
    return (docs.select("doc_id", "text").withColumn("score", quality.scored(trees, F.col("text")))
            .select("doc_id", F.coalesce(id_fold(3) == 1, F.lit(True)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query
def op4_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op9_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprinted(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


# A page is listed if its visible text is shorter than this many characters.
THIN_PAGE = 400


@query
def op10_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    listed = pages.filter(F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")) < THIN_PAGE)
    return urls.judged(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


ORACLES["op10_blocked_bloom"] = """
WITH parts AS (
  SELECT page_id, html, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keyed AS (
  SELECT page_id, html, host, path, CASE WHEN regexp_replace(host, '^www\\.', '') = '' THEN NULL ELSE
    regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical
  FROM (SELECT *, regexp_replace(regexp_replace('&' || regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1),
    '&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM parts)),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) < 400 AND canonical IS NOT NULL),
ruled AS (
  SELECT k.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM keyed k LEFT JOIN listed l ON k.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow'
  WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block'
  ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, canonical, listed FROM ruled
"""


@query
def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLES["op2_mtree_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.text_parts(turns))


ORACLES["op6_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<<SYS>>', '<\\<SYS>>'),
    '<</SYS>>', '<\\</SYS>>'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]',
    '[\\/INST]') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
"""


# A document is called toxic from this score on.
TOXIC_FROM = 0.7


@query
def op11_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), F.coalesce(id_fold(3) != 1, F.lit(False)))
    return (docs.select("doc_id", "text").withColumn("score", toxicity.scored(lexicon, F.col("text")))
            .select("doc_id", F.coalesce(id_fold(3) == 1, F.lit(True)).alias("held_out"), "score",
                    (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")))


@query
def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.aligned(table(spark, sf_dir, "documents"))
