"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, fingerprint, hard_negatives, host_quality, importance, jaccard_join, language_id, packing, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

OP1_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
cut AS (SELECT rule, verdict, regexp_extract(rule, '^([^/]*)', 1) AS h, regexp_extract(rule, '^[^/]*(.*)$', 1) AS p FROM rules),
parts AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, length(h) DESC, verdict DESC) AS i
  FROM parts JOIN cut ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE i = 1) USING (r)"""


@query("op1_url_filter", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(rule, verdict)")
    return url_filter.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), rules)


def _op2_sql() -> str:
    rates, prior, k = [], [], []
    for r, (cond, most) in host_quality.RULES.items():
        cond = cond.format(m="")
        k.append(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS k_{r}")
        prior.append(f"sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r}::DOUBLE * k_{r} / n) / sum(n) - (sum(k_{r}) / sum(n)) * (sum(k_{r}) / sum(n)) "
                     f"- (sum(k_{r}) / sum(n)) * (1 - sum(k_{r}) / sum(n)) * count(*) / sum(n) AS v_{r}")
        s = f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1), 10000) ELSE 10000 END"
        rates.append(f"(k_{r} + m_{r} * ({s})) / (n + ({s})) > {most}")
    base = " OR ".join(f"({host_quality.RULES[r][0].format(m='')})" for r in host_quality.BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM t),
pos AS (SELECT r, unnest(range(1, greatest(len(words) - 1, 1))) AS i, words FROM w),
win AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS g FROM pos),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) GROUP BY r),
f AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
hosts AS (SELECT source, count(*) AS n, {", ".join(k)} FROM f WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT {", ".join(prior)} FROM hosts),
bad AS (SELECT source, ({" OR ".join(rates)}) AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, coalesce(host_failed, false) AS host_failed,
  NOT ({base}) AND NOT coalesce(host_failed, false) AS kept FROM f LEFT JOIN bad USING (source)"""


@query("op2_quality_rules", _op2_sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of every document."""
    return host_quality.judge_documents(documents(spark, sf).select("doc_id", "text", "source")).select("doc_id", "quality.*")


@query("op4_sharding")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of 24 shards whose sizes differ by one row at most."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Words in 35-word windows that occur twice anywhere, removed."""
    return substring_dedup.remove_repeats(documents(spark, sf).select("doc_id", "text"), with_text=False).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes in 100-byte strings that also start earlier, removed."""
    out = suffix_dedup.remove_earlier(documents(spark, sf).select("doc_id", "text"), with_bytes=False)
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", "dedup.kept_sha256")


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document, and the bytes they decode to."""
    return byte_bpe.round_trip(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    docs = documents(spark, sf).select("doc_id", "text")
    return packed_documents(docs)


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "text_hash", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces, docs.count()).drop("text_hash")


@query("op3_simhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf))


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    out = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), language_id.identify(docs).alias("p"))
    return out.select("doc_id", "held_out", "p.*")


@query("op8_fingerprint")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.compare_edits(documents(spark, sf))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and rank of every document in a draw that resembles ``benchmark``."""
    return importance.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


OP12_SQL = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS s
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, s AS negative_score
FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score
QUALIFY rank <= 5"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_ngram_jaccard_join")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard_join.link_documents(documents(spark, sf))
