"""Corpus pipeline: five stages over ``documents``, each on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peaklake.llm import decontamination, jaccard_join, kd_sharding, mixing, quality
from peaklake.llm.common import arrow_rows, table, workspace

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, at least once and at most twice."""
    return mixing.mix(docs, mixing.Target(max_repeats=2.0))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of about equal bytes: the columns of documents and ``shard``."""
    return kd_sharding.shard(docs, shards=SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, the similarity join and the fingerprints have no form in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    work = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    with arrow_rows(spark):
        for name, stage in STAGES:
            docs = work.stage(stage(spark, docs, sf_dir), name)
    return docs
