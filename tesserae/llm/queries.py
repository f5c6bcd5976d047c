"""The queries of this subpackage, by name, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, fingerprints, lines, lm_scoring, mixing, ngram_join, nn_descent, substrings, toxicity, url_cascade
from tesserae.llm.common import table

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.deduplicated(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_ngram_join": op2_ngram_join, "op3_embedding_dedup": op3_embedding_dedup, "op4_lm_scoring": op4_lm_scoring, "op5_bpe": op5_bpe, "op6_substring_dedup": op6_substring_dedup, "op7_toxicity": op7_toxicity, "op8_url_filter": op8_url_filter, "op9_fingerprints": op9_fingerprints, "op10_mixing": op10_mixing}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH r AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(concat(doc_id, ':', text)), text) AS r, doc_id, text FROM documents),
l AS (
  SELECT r, u.i AS i, u.x AS x, trim(u.x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT r, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM r)),
n AS (SELECT r, i, t, row_number() OVER (PARTITION BY r ORDER BY i) AS pos FROM l WHERE t <> ''),
w AS (
  SELECT r, pos,
         t || chr(10) || lead(t, 1) OVER d || chr(10) || lead(t, 2) OVER d AS win
  FROM n WINDOW d AS (PARTITION BY r ORDER BY pos)),
later AS (
  SELECT r, pos FROM (SELECT r, pos, row_number() OVER (PARTITION BY win ORDER BY r, pos) AS k FROM w WHERE win IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT n.r, n.i FROM n JOIN later ON n.r = later.r AND n.pos BETWEEN later.pos AND later.pos + 2),
o AS (
  SELECT l.r, count(*) FILTER (WHERE t <> '') AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.r = gone.r AND l.i = gone.i
  GROUP BY l.r)
SELECT r.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(o.text) AS text_sha256, length(o.text) AS n_chars
FROM r LEFT JOIN o ON r.r = o.r
""",
    "op8_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m USING (page_id)
""",
}
