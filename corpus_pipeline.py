"""A training corpus from ``documents``: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and calls one operator of
``chronopanel.llm``. Rows keep the columns of ``documents``; the last stage gives the packed pieces.
Stages keep repeated rows apart only as far as their operator does; empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronopanel.llm import host_quality, language_id, simhash, substring_dedup
from chronopanel.llm.common import names
from chronopanel.llm.queries import packed_documents
from chronopanel.shared import scratch_dir

#: a text whose best language holds less than this share of the score is rejected
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts of no clear language go."""
    judged = docs.withColumn("__language", language_id.identify(docs))
    return judged.where((F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).select(*names(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go."""
    return host_quality.judge_documents(docs).where("quality.kept").select(*names(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8 or more."""
    return simhash.one_per_group(docs).select(*names(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows go; an untouched text stays as it is."""
    cut = substring_dedup.remove_repeats(docs)
    out = cut.withColumn("text", F.col("dedup.kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("dedup.n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return packed_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: language identification is learned; SQL cannot express it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
