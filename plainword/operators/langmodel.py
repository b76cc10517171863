"""Trigram language model: interpolated Kneser-Ney with one discount, as tables of counts.

p3(w | u v) = max(c(u v w) - D, 0) / c(u v .) + D n(u v .) / c(u v .) * p2(w | v), p2 likewise over continuation counts (distinct left neighbours), and
p1(w) = distinct left neighbours of w / distinct bigrams. Unknown words get ``floor``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

DISCOUNT, FLOOR = 0.75, 1e-7


@dataclass
class Model:
    trigrams: DataFrame  # a, b, c, n
    bigrams: DataFrame  # b, c, n: continuation counts
    unigrams: DataFrame  # c, p


def trigrams(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """a, b, c, each as often as it occurs. Texts are padded with two <s> and one </s>; empty ones have none."""
    padded = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), F.col(tokens), F.array(F.lit("</s>")))
    t = df.filter(F.size(tokens) > 0).select(padded.alias("t"))
    g = t.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("t") - 3), lambda i: F.struct(F.get("t", i).alias("a"), F.get("t", i + 1).alias("b"), F.get("t", i + 2).alias("c")))).alias("g"))
    return g.select("g.a", "g.b", "g.c")


def trigram_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """a, b, c, n."""
    return trigrams(df, tokens).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, tokens: str = "tokens") -> Model:
    tri = trigram_counts(df, tokens)
    bi = tri.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n"))
    uni = bi.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total = uni.agg(F.sum("n").alias("total"))
    return Model(tri, bi, uni.join(F.broadcast(total)).select("c", (F.col("n") / F.col("total")).alias("p")))  # one row is broadcast


def score(grams: DataFrame, model: Model, floor: float = FLOOR) -> DataFrame:
    """grams (a, b, c and others) with ``logp``: natural logarithm of p3(c | a b)."""
    g = grams.select("a", "b", "c").distinct()
    h3 = model.trigrams.groupBy("a", "b").agg(F.sum("n").alias("__c3"), F.count(F.lit(1)).alias("__n3"))
    h2 = model.bigrams.groupBy("b").agg(F.sum("n").alias("__c2"), F.count(F.lit(1)).alias("__n2"))
    j = g.join(model.unigrams.withColumnRenamed("p", "__p1"), "c", "left").join(model.bigrams.withColumnRenamed("n", "__k2"), ["b", "c"], "left").join(h2, "b", "left")
    j = j.join(model.trigrams.withColumnRenamed("n", "__k3"), ["a", "b", "c"], "left").join(h3, ["a", "b"], "left")
    return grams.join(j.select("a", "b", "c", _logp(floor).alias("logp")), ["a", "b", "c"])


def _logp(floor: float) -> Column:
    """From __p1, and of bigrams and trigrams the count __k, the count of the words before __c and the number of their followers __n."""
    p1 = F.coalesce("__p1", F.lit(floor))
    part = lambda k, c, n, below: F.when(F.col(c).isNull(), below).otherwise(F.greatest(F.coalesce(F.col(k), F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col(c) + DISCOUNT * F.col(n) / F.col(c) * below)
    return F.log(part("__k3", "__c3", "__n3", part("__k2", "__c2", "__n2", p1)))


def score_under(df: DataFrame, grams: DataFrame, floor: float = FLOOR) -> DataFrame:
    """a, b, c, logp of distinct ``grams`` under the model of ``df``, as ``score`` gives it.

    The grams are counted along with the texts' own, so no count of the model is joined but those asked for; each table of counts is written before the next is made."""
    asked = F.max("asked").alias("asked")
    row = lambda g, n, wanted: g.select("a", "b", "c", F.lit(n).cast("long").alias("n"), F.lit(wanted).alias("asked"))
    both = row(trigrams(df), 1, False).unionByName(row(grams, 0, True))
    tri = saved(both.groupBy("a", "b", "c").agg(F.sum("n").alias("n"), asked), "trigrams")
    met = F.count_if(F.col("n") > 0)
    h3 = saved(tri.groupBy("a", "b").agg(F.sum("n").alias("__c3"), met.alias("__n3"), asked).filter("asked AND __c3 > 0").drop("asked"), "trigram-heads")
    bi = saved(tri.groupBy("b", "c").agg(met.alias("n"), asked), "bigrams")
    seen = bi.filter("n > 0")
    h2 = seen.groupBy("b").agg(F.sum("n").alias("__c2"), F.count(F.lit(1)).alias("__n2"))
    uni = seen.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    uni = uni.join(F.broadcast(uni.agg(F.sum("n").alias("total")))).select("c", (F.col("n") / F.col("total")).alias("__p1"))  # one row is broadcast
    j = tri.filter("asked").select("a", "b", "c", F.col("n").alias("__k3")).join(uni, "c", "left").join(bi.filter("asked").select("b", "c", F.col("n").alias("__k2")), ["b", "c"], "left")
    return j.join(h2, "b", "left").join(h3, ["a", "b"], "left").select("a", "b", "c", _logp(floor).alias("logp"))


def lm_ranked(candidates: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """candidates (keys, cand, left, right; null beyond the text) with ``lm`` (log p of left cand right) and ``rank``, best first."""
    left, right = F.coalesce("left", F.lit("<s>")), F.coalesce("right", F.lit("</s>"))
    c = candidates.withColumns({"__l": left, "__r": right})
    mid = c.select(F.lit("<s>").alias("a"), F.col("__l").alias("b"), F.col("cand").alias("c")).distinct()
    end = c.select(F.col("__l").alias("a"), F.col("cand").alias("b"), F.col("__r").alias("c")).distinct()
    s1 = score(mid, model).select(F.col("b").alias("__l"), F.col("c").alias("cand"), F.col("logp").alias("__p"))
    s2 = score(end, model).select(F.col("a").alias("__l"), F.col("b").alias("cand"), F.col("c").alias("__r"), F.col("logp").alias("__q"))
    scored = c.join(s1, ["__l", "cand"]).join(s2, ["__l", "cand", "__r"]).withColumn("lm", F.col("__p") + F.col("__q")).drop("__l", "__r", "__p", "__q")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("lm", 9).desc(), "cand")))
