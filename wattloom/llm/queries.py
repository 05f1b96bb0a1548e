"""One query per operator, each over its whole table, with DuckDB statements where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import interactions, minhash, overlap, packing, pii, quality, repeats, templates, tiling, tokens, urls, variants, warc
from .common import table, with_word_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rules(table(spark, folder, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text", F.xxhash64("text").alias("copies"))
    return packing.best_fit(with_word_counts(docs, "text", "n"), "doc_id", "n", "source", "copies", capacity=2048)


@query("op5_line_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    left = templates.without_recurring(table(spark, folder, "documents"), n_lines="n_lines", n_dropped="n_dropped")
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.deduplicated(table(spark, folder, "documents"), width=35).drop("kept_text")


@query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("__key")


@query("op4_token_ids")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_index(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# the canonical form as in ``urls.canonical``; rules by length, the longest first
OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL THEN '' ELSE translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL THEN '' ELSE regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') END AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS asked
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN asked = '' THEN '' ELSE '?' || asked END END AS canonical FROM parts),
listed AS (SELECT canonical FROM keyed WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM keyed)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judge(pages, urls.captured_again(pages))


@query("op10_warc")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archived(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


@query("op1_pii")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents"))


# failed filters as bits of a mask; every order is a tuple of different letters
OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
judged AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS fails
  FROM cut),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, fails),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON a.bit <> b.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
    JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS earlier
  FROM orders, range(1, 6) AS r(i)),
told AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told"""


@query("op12_filter_interactions", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    failed = interactions.failures(table(spark, folder, "documents"))
    return interactions.audit(interactions.tallies(failed, table(spark, folder, "labels")))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    words = variants.word_counts(table(spark, folder, "documents"), least_chars=5, least=3, slip=97)
    return variants.spelling_variants(words)


@query("op13_ngram_jaccard_join")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.jaccard_links(table(spark, folder, "documents"), width=4, percent=85).drop("cls")
