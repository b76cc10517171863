"""The row-local operators and the duplicate filter on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import canonical_key
from ..sources.readers import parse_raw


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """text, tokens, of new text files in a folder."""
    return parse_raw(spark.readStream.text(path))


#: Pairs of a mapping at most: it is one value, which is sent to every task.
MOST_PAIRS = 1_000_000


def simple_normalise_stream(tweets: DataFrame, dictionary: DataFrame, mapping: DataFrame) -> DataFrame:
    """tweets with norm_tokens. The mapping is read anew in each batch and gathered into one map; more than ``MOST_PAIRS`` pairs are an error, none is left out."""
    pairs = mapping.join(dictionary.select(F.col("word").alias("oov")), "oov", "left_anti")
    entries = F.collect_list(F.struct("oov", "iv"))
    table = pairs.agg(F.when(F.count(F.lit(1)) > MOST_PAIRS, F.raise_error(F.lit(f"the mapping has more than {MOST_PAIRS} pairs")).cast("map<string,string>")).otherwise(F.map_from_entries(entries)).alias("__map"))
    return tweets.join(F.broadcast(table)).withColumn("norm_tokens", F.transform("tokens", lambda x: F.coalesce(F.try_element_at(F.col("__map"), x), x))).drop("__map")


def without_duplicates_stream(tweets: DataFrame, time: str | None = None, delay: str = "1 hour", least: int = 3) -> DataFrame:
    """First row of each key. With an event time, keys are forgotten after ``delay``."""
    keyed = tweets.withColumn("__k", canonical_key(F.col("text"))).filter(F.size("__k") >= least).withColumn("__h", F.sha2(F.array_join("__k", " ").cast("binary"), 256)).drop("__k")
    if time:
        return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["__h"]).drop("__h")
    return keyed.dropDuplicates(["__h"]).drop("__h")
