"""One registered query per numbered operator, over its whole table; SQL oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontam, importance, license, minhash, phrases, pii, quality, secrets, sentencepiece, shards, tokens,
               warc, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


@register("op2_license_scan")
def op2(spark, sf_dir):
    return license.scan(documents(spark, sf_dir))


@register("op3_benchmark_decontamination")
def op3(spark, sf_dir):
    return decontam.leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


@register("op4_sentencepiece")
def op4(spark, sf_dir):
    return sentencepiece.encode(documents(spark, sf_dir))


@register("op5_sharding")
def op5(spark, sf_dir):
    return shards.assign(documents(spark, sf_dir))


@register("op6_token_counts")
def op6(spark, sf_dir):
    return tokens.by_section(documents(spark, sf_dir))


@register("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


@register("op8_substring_dedup")
def op8(spark, sf_dir):
    return phrases.dedup(documents(spark, sf_dir))


@register("op9_quality_rules")
def op9(spark, sf_dir):
    return quality.verdicts(documents(spark, sf_dir))


@register("op10_pii")
def op10(spark, sf_dir):
    return pii.scan(documents(spark, sf_dir))


#: Base32 of the SHA-1: 32 digits of five bits, each from the group of five hex digits (20 bits) it lies in.
OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
  max(page_id) OVER (PARTITION BY payload) AS original FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT),
    1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""


@register("op11_warc", OP11)
def op11(spark, sf_dir):
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


#: CRC-32 of each distinct word by its table, byte by byte; then counts, gains, scores and the draw.
OP12 = """
WITH crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
target_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words)),
buckets AS (SELECT w, xor(list_reduce(list_transform(range(1, strlen(h), 2),
    lambda i: CAST('0x' || substr(h, CAST(i AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(1 + (xor(c, b) & 255) AS INT)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM words, crc_table),
doc_buckets AS (SELECT doc_id, bucket FROM doc_words JOIN buckets USING (w)),
s AS (SELECT bucket, count(*) AS n FROM doc_buckets GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (w) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM doc_buckets JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
    / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank
FROM placed
"""


@register("op12_importance_resampling", OP12)
def op12(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("n_words")


@register("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
