"""Votes, cuts and rank aggregation. ``keys`` name the token that candidates belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import common_prefix_length, common_suffix_length, longest_common_subsequence
from .similarity import subsequence_kernel


def take_percent(df: DataFrame, percent: int, order: list[Column], keys: list[str] = ()) -> DataFrame:
    """The first ``percent`` of the rows of each group, rounded down in whole numbers."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.expr(f"__r <= __n * {percent} div 100")).drop("__r", "__n")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the single most frequent value; null on a tie."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.groupBy(*keys).agg(F.max("__n").alias("__m"), F.max_by(value, "__n").alias("__v"))
    ties = counts.join(top, keys).filter("__n = __m").groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"), F.first("__v").alias("__v"))
    return ties.select(*keys, F.when(F.col("__k") == 1, F.col("__v")).alias(value))


def predict_vote(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, vote: 'pos' if more labels are 'pos' than not, else 'neg'."""
    pos = F.count_if(F.col(label) == "pos")
    return df.groupBy(*keys).agg(F.when(pos > F.count_if(F.col(label) == "neg"), "pos").otherwise("neg").alias("vote"))


def ill_formed(votes: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, ill: whether at least ``least`` candidates have the vote 'pos'."""
    return votes.groupBy(*keys).agg((F.count_if(F.col("vote") == "pos") >= least).alias("ill"))


def rank_by(df: DataFrame, keys: list[str], score: Column, out: str, descending: bool = False) -> DataFrame:
    """0-based dense rank within ``keys``."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(score.desc() if descending else score.asc())) - 1)


def candidate_scores(df: DataFrame, keys: list[str], token: str = "query", cand: str = "cand", duplicates_count: bool = False) -> DataFrame:
    """keys, cand, rank_sum: dense ranks by edit distance, kernel, subsequence, prefix and suffix, summed; a candidate's copies add up only if ``duplicates_count``."""
    each = df.groupBy(*dict.fromkeys([*keys, token]), cand).agg(F.count(F.lit(1)).alias("__copies"))
    pairs = each.select(F.col(token).alias("query"), F.col(cand).alias("cand")).distinct()
    q, c = F.col("query"), F.col("cand")
    measured = subsequence_kernel(pairs).select(
        F.col("query").alias("__q"), F.col("cand").alias("__c"), F.levenshtein(q, c).alias("__lev"), F.round("ssk", 9).alias("__ssk"), longest_common_subsequence(q, c).alias("__lcs"),
        common_prefix_length(q, c).alias("__pre"), common_suffix_length(q, c).alias("__suf"),
    )
    met = each.join(measured, (F.col(token) == F.col("__q")) & (F.col(cand) == F.col("__c")))
    total = F.lit(0)
    for name, down in (("__lev", False), ("__ssk", True), ("__lcs", True), ("__pre", True), ("__suf", True)):
        met = rank_by(met, list(keys), F.col(name), f"{name}_r", down)
        total = total + F.col(f"{name}_r")
    score = total * F.col("__copies") if duplicates_count else total
    return met.select(*keys, F.col(cand).alias("cand"), score.cast("long").alias("rank_sum"))


def choose_candidate(df: DataFrame, keys: list[str], token: str = "query", cand: str = "cand", duplicates_count: bool = False) -> DataFrame:
    """keys, cand: the least rank sum; then the first word."""
    scored = candidate_scores(df, keys, token, cand, duplicates_count)
    return scored.groupBy(*keys).agg(F.min(F.struct("rank_sum", "cand")).alias("b")).select(*keys, F.col("b.cand").alias("cand"))
