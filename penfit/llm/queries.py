"""Registered queries of the operators, and their DuckDB SQL where SQL can
express them. Each query applies its operator with production parameters to
the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penfit.llm import ann, context_mixing
from penfit.llm.common import read_table
from penfit.llm.exact_dedup import exact_dedup
from penfit.llm.filter_audit import audit_filters
from penfit.llm.mixing import mix, taken_words
from penfit.llm.ngram_join import near_components
from penfit.llm.packing import pack_documents
from penfit.llm.periodic_runs import looped, periodic_runs
from penfit.llm.sharding import shard_rows
from penfit.llm.token_counts import count_tokens
from penfit.llm.token_files import new_token_path, read_documents, token_digest, write_tokens
from penfit.llm.toxicity import score_documents
from penfit.llm.url_filters import dated_captures, derived_events, filter_urls

_CONTRACT_4 = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_multi_match_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(read_table(spark, sf_dir, "documents"), new_token_path(spark))
    return token_digest(read_documents(spark, path))


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents")).select(*_CONTRACT_4)


def op5_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(dated_captures(pages), derived_events(pages))


def op10_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, spans = mix(read_table(spark, sf_dir, "documents"))
    return taken_words(documents, spans).select("doc_id", "size", "source_size", "target", "taken")


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), prepare=looped)


QUERIES = {
    "op1_compression_toxicity": op1_compression_toxicity,
    "op2_multi_match_ngram_join": op2_multi_match_ngram_join,
    "op3_token_files": op3_token_files,
    "op4_feistel_sharding": op4_feistel_sharding,
    "op5_pretoken_counts": op5_pretoken_counts,
    "op6_lexical_packing": op6_lexical_packing,
    "op7_extendible_hash_dedup": op7_extendible_hash_dedup,
    "op8_adaptive_scan_ann": op8_adaptive_scan_ann,
    "op9_temporal_url_filters": op9_temporal_url_filters,
    "op10_mixing_blocks": op10_mixing_blocks,
    "op11_context_mixing": op11_context_mixing,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""

# The list is a rule over hosts, so its state on a day has a closed form: no
# events, no intervals, no join.
OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS DATE) AS fetched,
         (page_id * 37) % 730 AS day,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)', 1) AS segment
  FROM pages),
k AS (
  SELECT *, CASE WHEN len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS parent,
         host || '/' || segment AS prefix
  FROM p),
parents AS (SELECT DISTINCT parent AS entry FROM k WHERE host <> ''),
up AS (
  SELECT page_id, day, host AS entry FROM k
  UNION SELECT page_id, day, regexp_replace(host, '^[^.]*\.', '') FROM k
  UNION SELECT page_id, day, regexp_replace(host, '^[^.]*\.[^.]*\.', '') FROM k),
n AS (SELECT *, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS a FROM up SEMI JOIN parents USING (entry)),
m AS (SELECT *, CAST('0x' || substr(md5(prefix), 1, 8) AS BIGINT) AS b FROM k WHERE host <> ''),
hit AS (
  SELECT page_id, entry FROM n
  WHERE a % 3 = 0 AND ((day >= a % 400 AND day < a % 400 + 60 + (a // 7) % 100)
                       OR (a % 2 = 0 AND day >= a % 400 + 250))
  UNION ALL SELECT page_id, prefix FROM m WHERE b % 10 = 0 AND day >= b % 500)
SELECT page_id, host, fetched, count(hit.entry) > 0 AS blocked, count(hit.entry) AS active, min(hit.entry) AS entry
FROM k LEFT JOIN hit USING (page_id) GROUP BY page_id, host, fetched
"""

# Documents are counted per mask before they meet the 600 steps.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, good, toxic, count(*) AS rows FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
             [strpos('ABCDE', substr(filter_order, i, 1)) FOR i IN range(1, step)] AS earlier
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT m.*, s.*, fails[strpos('ABCDE', letter)] AS fails_this,
         len([i FOR i IN earlier IF fails[i]]) > 0 AS gone,
         fails[strpos('ABCDE', letter)] AND len([b FOR b IN fails IF b]) = 1 AS only_this
  FROM m, s),
t AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
         CAST(sum(CASE WHEN NOT gone AND NOT fails_this THEN rows ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fails_this AND NOT gone THEN rows ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails_this AND gone THEN rows ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN only_this THEN rows ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fails_this AND NOT gone AND good = 1 THEN rows ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fails_this AND NOT gone AND toxic = 1 THEN rows ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM t
"""

ORACLES = {"op12_filter_audit": OP12_SQL, "op9_temporal_url_filters": OP9_SQL, "op7_extendible_hash_dedup": OP7_SQL}
