"""Connected components of an edge table, by alternating large-star and small-star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped
from .common import saved

#: So many edges are one task's work: dealt out, each round would cost several tasks a partition for a handful of numbers each.
FEW = 1 << 16


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    both = both.coalesce(1) if few else both
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    both = moved.union(least.select("u", F.col("m").alias("v")))
    return (both.coalesce(1) if few else both).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v): each node of a component except its least, with the least. edges: (u, v) of one ordered type, no nulls; loops and repeats are ignored.

    Each round is written to the shared folder, in place of the one before; it ends when a round changes nothing (count and two sums of hashes).
    A round of at most ``FEW`` edges is one task."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, mark = saved(now, "edges"), None
    for _ in range(limit):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if found[0] == 0 or tuple(found) == mark:
            return now
        mark = tuple(found)
        few, last = found[0] <= FEW, now
        now = saved(_small_star(_large_star(last.coalesce(1) if few else last, few), few), "edges")
        dropped(last)
    raise RuntimeError(f"no end after {limit} rounds")
