"""A training-corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.llm import decontaminate, mixing, quality, sharding, similar
from cairnway.llm.common import table
from cairnway.llm.labelled import crc_mod
from cairnway.plans.staging import staged

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
WINDOW = 10
SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return similar.keep_one(docs, words=5, min_similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=WINDOW)
    return marked.filter(~F.col("contaminated")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that every source holds the same share of the characters."""
    return mixing.mix(docs).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every document."""
    return sharding.assign_shards(docs, SHARDS).drop("grown_shard")


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned scores and similarity groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
