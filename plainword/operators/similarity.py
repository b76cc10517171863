"""Distributional similarity of word pairs, from context counts (word, off, gram, cnt).

A measure sums over features: only pairs that are asked for are compared, by an equi-join on the feature. Mutual information of a word and a feature is
log(cnt * all / (word total * feature total)), at least 0. Distances are negated, so more is nearer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, saved

#: measure: (value of a feature, what a word sums over its features (of a column or an array), what a pair sums over shared features, result of the sums a, b and s).
MEASURES = {
    "cosine": ("cnt", lambda x: x * x, lambda x, y: x * y, lambda a, b, s: s / F.sqrt(a * b)),
    "dice": ("cnt", lambda x: x**0, lambda x, y: F.lit(1.0), lambda a, b, s: 2 * s / (a + b)),
    "jaccard": ("cnt", lambda x: x**0, lambda x, y: F.lit(1.0), lambda a, b, s: s / (a + b - s)),
    "overlap": ("cnt", lambda x: x**0, lambda x, y: F.lit(1.0), lambda a, b, s: s / F.least(a, b)),
    "tanimoto": ("cnt", lambda x: x * x, lambda x, y: x * y, lambda a, b, s: s / (a + b - s)),
    "cosine_mi": ("mi", lambda x: x * x, lambda x, y: x * y, lambda a, b, s: s / F.sqrt(a * b)),
    "dice_mi": ("mi", lambda x: x, lambda x, y: F.least(x, y), lambda a, b, s: 2 * s / (a + b)),
    "jaccard_mi": ("mi", lambda x: x, lambda x, y: F.least(x, y), lambda a, b, s: s / (a + b - s)),
    "recall_mi": ("mi", lambda x: x, lambda x, y: x, lambda a, b, s: s / a),
    "precision_recall_mi": ("mi", lambda x: x, lambda x, y: F.least(x, y), lambda a, b, s: s / F.greatest(a, b)),
    "lin": ("mi", lambda x: x, lambda x, y: x + y, lambda a, b, s: s / (a + b)),
    "hindle": ("mi", lambda x: x, lambda x, y: F.least(x, y), lambda a, b, s: s),
    "lp": ("prob", lambda x: x * x, lambda x, y: x * y, lambda a, b, s: -F.sqrt(F.greatest(a + b - 2 * s, F.lit(0.0)))),
    "confusion": ("prob", lambda x: x, lambda x, y: x * y, lambda a, b, s: s),
    "jensen": ("prob", lambda x: x, lambda x, y: x * F.log2(2 * x / (x + y)) + y * F.log2(2 * y / (x + y)) - x - y, lambda a, b, s: -(a + b + s) / 2),
    "lee": ("prob", lambda x: x, lambda x, y: x * F.log(x / (0.99 * y + 0.01 * x)) - x * F.log(F.lit(100.0)), lambda a, b, s: -(a * F.log(F.lit(100.0)) + s)),
}


#: Pairs meet in so many rounds, by candidate. All of them meet, and each value is dealt out in the round of its word alone; on disk is one round's share at a time.
PARTS = 8


def _saved_values(counts: DataFrame, value: str) -> DataFrame:
    """``valued``, with one copy in the shared folder: of the counts where values are cheap to make from them, else of the values."""
    kept = saved(counts, "context-counts")
    if value != "mi":
        return valued(kept, value)
    values = saved(valued(kept, value), "context-values")
    dropped(kept)
    return values


def valued(counts: DataFrame, value: str) -> DataFrame:
    """word, off, gram, x: counts, probabilities within the word, or mutual information."""
    if value == "cnt":
        return counts.select("word", "off", "gram", F.col("cnt").cast("double").alias("x"))
    words = counts.groupBy("word").agg(F.sum("cnt").alias("__w"))
    by_word = counts.join(words, "word")
    if value == "prob":
        return by_word.select("word", "off", "gram", (F.col("cnt") / F.col("__w")).alias("x"))
    features = counts.groupBy("off", "gram").agg(F.sum("cnt").alias("__f"))
    total = counts.agg(F.sum("cnt").alias("__t"))
    mi = F.log(F.col("cnt").cast("double") * F.col("__t") / (F.col("__w").cast("double") * F.col("__f")))
    return by_word.join(features, ["off", "gram"]).join(F.broadcast(total)).select("word", "off", "gram", F.greatest(mi, F.lit(0.0)).alias("x"))  # one row is broadcast


def similarity(pairs: DataFrame, counts: DataFrame, measure: str = "lin") -> DataFrame:
    """query, cand, score, for pairs (query, cand) that share a feature."""
    value, own, both, combine = MEASURES[measure]
    v = _saved_values(counts, value)
    norms = v.groupBy("word").agg(F.sum(own(F.col("x"))).alias("norm"))
    own, sums = pairs.select("query", "cand").distinct(), None
    for k in range(PARTS):
        here = F.pmod(F.xxhash64("cand"), F.lit(PARTS)) == k
        a = own.filter(here).join(v.select(F.col("word").alias("query"), "off", "gram", F.col("x").alias("x")), "query")
        met = a.join(v.select(F.col("word").alias("cand"), "off", "gram", F.col("x").alias("y")).filter(here), ["cand", "off", "gram"])
        part = saved(met.groupBy("query", "cand").agg(F.sum(both(F.col("x"), F.col("y"))).alias("s")), "similarity-sums")
        sums = part if sums is None else sums.unionByName(part)
    with_a = sums.join(norms.select(F.col("word").alias("query"), F.col("norm").alias("a")), "query")
    with_b = with_a.join(norms.select(F.col("word").alias("cand"), F.col("norm").alias("b")), "cand")
    score: Column = combine(F.col("a"), F.col("b"), F.col("s"))
    return with_b.select("query", "cand", score.alias("score")).filter(F.col("score").isNotNull())


def best_pair(scored: DataFrame) -> DataFrame:
    """query, cand, score: the highest score, then the last word."""
    best = F.max(F.struct("score", "cand")).alias("b")
    return scored.groupBy("query").agg(best).select("query", F.col("b.cand").alias("cand"), F.col("b.score").alias("score"))


def kernel_features(words: DataFrame, word: str = "word", decay: float = 0.5) -> DataFrame:
    """word, feature, weight: pairs of characters in order, weighted decay**(distance + 1), summed."""
    chars = words.select(F.col(word).alias("word")).distinct().select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("c"))
    one = chars.select("word", "c", F.posexplode("c").alias("i", "u"))
    two = one.select("word", "i", "u", F.posexplode("c").alias("j", "v")).filter("j > i")
    return two.groupBy("word", F.concat("u", "v").alias("feature")).agg(F.sum(F.pow(F.lit(decay), F.col("j") - F.col("i") + 1)).alias("weight"))


def subsequence_kernel(pairs: DataFrame, decay: float = 0.5) -> DataFrame:
    """query, cand, ssk: normalised string subsequence kernel of order 2 (Lodhi et al., 2002); 0 where nothing is shared."""
    own = pairs.select("query", "cand").distinct()
    f = kernel_features(own.select(F.col("query").alias("word")).union(own.select("cand")), decay=decay)
    norm = f.groupBy("word").agg(F.sum(F.col("weight") * F.col("weight")).alias("k"))
    dots = own.join(f.select(F.col("word").alias("query"), "feature", F.col("weight").alias("x")), "query").join(f.select(F.col("word").alias("cand"), "feature", F.col("weight").alias("y")), ["cand", "feature"])
    k = dots.groupBy("query", "cand").agg(F.sum(F.col("x") * F.col("y")).alias("k12"))
    full = own.join(k, ["query", "cand"], "left").join(norm.select(F.col("word").alias("query"), F.col("k").alias("k1")), "query", "left").join(norm.select(F.col("word").alias("cand"), F.col("k").alias("k2")), "cand", "left")
    return full.select("query", "cand", F.coalesce(F.col("k12") / F.sqrt(F.col("k1") * F.col("k2")), F.lit(0.0)).alias("ssk"))


def ranked_pairs(pairs: DataFrame, limit: int = 40000) -> DataFrame:
    """query, cand, ssk, in the order of ssk (highest first), query, cand; the first ``limit``."""
    scored = subsequence_kernel(pairs)
    return scored.orderBy(F.round("ssk", 9).desc(), "query", "cand").limit(limit)


def with_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))
