"""The corpus pipeline: each stage works on all that the one before kept, through Parquet in the shared folder. What the driver holds of the one before goes first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plainword.llm import decontam, mixing, quality_model, shard_minimax, shingle_join
from plainword.llm.common import load, shared_dir, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    tidy(spark)
    return quality_model.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of five-word shingles at least 0.8) stays: the one with the smallest id.

    Close SimHash pairs from the vantage-point tree first, then an exact prefix filter for what 64 bits can't reach; every link is an exact Jaccard comparison."""
    tidy(spark)
    return shingle_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    tidy(spark)
    return decontam.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: not at all, once or twice."""
    tidy(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    tidy(spark)
    return shard_minimax.minimax_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained models and components of links can't be written in SQL. Tests hold the operators of stages 2 to 5 against brute-force versions; the classifier by accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
