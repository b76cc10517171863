"""Dependency bank: how often a dictionary word governs an unknown word at an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE = """
basic-dependencies struct<dep: array<struct<_type: string, governor: struct<_VALUE: string, _idx: string>, dependent: struct<_VALUE: string, _idx: string>>>>,
tokens struct<token: array<struct<_id: string, word: string>>>
""".replace("basic-dependencies", "`basic-dependencies`")


def read_sentences(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """sid, tokens (lower-case words), deps (type, gov, dep as text), of parsed XML; ``glob`` selects files, gzip is decoded by name."""
    reader = spark.read.format("xml").option("rowTag", "sentence").schema(SENTENCE)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return raw.select(
        F.xxhash64(F.to_json(F.struct("*"))).alias("sid"),
        F.transform("tokens.token", lambda t: F.lower(t["word"])).alias("tokens"),
        F.transform(F.coalesce(F.col("`basic-dependencies`.dep"), F.array().cast("array<struct<_type:string,governor:struct<_VALUE:string,_idx:string>,dependent:struct<_VALUE:string,_idx:string>>>")), lambda d: F.struct(d["_type"].alias("type"), d["governor"]["_idx"].alias("gov"), d["dependent"]["_idx"].alias("dep"))).alias("deps"),
    )


def untyped_dependencies(sentences: DataFrame, dictionary: DataFrame, reach: int = 3) -> DataFrame:
    """gov, off: no roots; both in the sentence and at most ``reach`` apart; gov in the dictionary and the dependent not. Indices that are no numbers are skipped."""
    d = sentences.select("tokens", F.explode("deps").alias("d")).filter(F.coalesce(F.col("d.type"), F.lit("")) != "root")
    i, j = F.col("d.gov").try_cast("int"), F.col("d.dep").try_cast("int")
    n = d.select("tokens", i.alias("i"), j.alias("j")).filter((F.col("i") >= 1) & (F.col("j") >= 1) & (F.abs(F.col("i") - F.col("j")) <= reach))
    words = n.select(F.get("tokens", F.col("i") - 1).alias("gov"), F.get("tokens", F.col("j") - 1).alias("word"), (F.col("i") - F.col("j")).alias("off")).filter("gov IS NOT NULL AND word IS NOT NULL")
    known = dictionary.select("word").distinct()
    return words.join(known, "word", "left_anti").join(known.withColumnRenamed("word", "gov"), "gov", "left_semi").select("gov", "off")


def dependency_frequency(deps: DataFrame) -> DataFrame:
    """gov, off, score: share of all dependencies."""
    total = deps.agg(F.count(F.lit(1)).alias("__t"))
    return deps.groupBy("gov", "off").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("gov", "off", (F.col("n") / F.col("__t")).alias("score"))  # one row is broadcast
