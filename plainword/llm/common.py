"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import tidy, trim  # noqa: F401

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_of(text: Column, chars: str) -> Column:
    """Characters of ``text`` in the regex class body ``chars``. Runs of other characters go in one step each."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if the whole of Spark is this one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plainword.scratch.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plainword-")
        spark.conf.set("plainword.scratch.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column], out: str) -> DataFrame:
    """0-based rank of each row within ``keys`` (never null), gapless, by (salt, order).

    A hot key is never sorted in one task: rows are ranked within (keys, salt), and the offset of each
    salt comes from a count per (keys, salt), which is at most one row per key and salt value."""
    b = df.withColumn("__salt", salt)
    by = [*keys, "__salt"]
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    ranked = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return ranked.join(offsets, by).withColumn(out, (F.col("__off") + F.col("__rn")).cast("long")).drop("__salt", "__rn", "__off")
