"""Candidate words for a token: near in spelling, or near in sound.

Words within an edit distance are found by an equi-join on segments: a word cut into d + 1 parts keeps one of them whole under d edits, at a place that the
lengths bound (Li, Deng, Wang, Feng: Pass-Join, 2011). The distance itself is checked after the join, so the result is exact for words of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metaphone import primary_code
from ..functions.strings import remove_repetition
from ..session import saved

#: Parts of a lexicon that queries meet one by one.
_PARTS = 64


def _part(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Place (from 1) and length of part ``i`` of a word of ``length`` characters cut into ``parts``; the longer parts come last."""
    base, first_longer = F.floor(length / parts), parts - length % parts
    return 1 + base * i + F.greatest(F.lit(i) - first_longer, F.lit(0)), base + (F.lit(i) >= first_longer).cast("int")


def _key(length: Column, i: int, text: Column) -> Column:
    return F.struct(length.cast("int").alias("n"), F.lit(i).alias("i"), text.alias("s"))


def segments(word: Column, d: int) -> Column:
    """Keys (n, i, s) of a word: its d + 1 parts. A word too short for that has the one key of its length."""
    n = F.length(word)
    parts = [_part(n, i, d + 1) for i in range(d + 1)]
    return F.when(n > d, F.array(*(_key(n, i, F.substring(word, at, size)) for i, (at, size) in enumerate(parts)))).otherwise(F.array(_key(n, 0, F.lit(""))))


def probes(word: Column, d: int) -> Column:
    """Keys that a word within distance ``d`` of this one can have. With the words' lengths ``k`` apart, ``i`` parts before and ``d - i`` behind, an unedited part
    has moved by at most ``i`` from its place counted from the front, and by at most ``d - i`` counted from the end."""
    n, keys = F.length(word), []
    for k in range(-d, d + 1):
        other = n - k
        for i in range(d + 1):
            at, size = _part(other, i, d + 1)
            for move in range(max(-i, k - (d - i)), min(i, k + (d - i)) + 1):
                there = at + move
                keys.append(F.when((other > d) & (there >= 1) & (there + size <= n + 1), _key(other, i, F.substring(word, there, size))))
        keys.append(F.when((other >= 0) & (other <= d), _key(other, 0, F.lit(""))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def find_within(queries: DataFrame, lexicon: DataFrame, d: int, word: str = "word") -> DataFrame:
    """query, cand, dist: every lexicon word within distance ``d`` of a query word. Null words match nothing."""
    # Few words make much work here: their bytes alone would put them into one task.
    spark = queries.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = queries.select(F.col(word).alias("query")).filter("query IS NOT NULL").repartition(tasks, "query").distinct()
    q = own.select("query", F.explode(probes(F.col("query"), d)).alias("__k"))
    c = lexicon.select(F.col("word").alias("cand")).filter("cand IS NOT NULL").distinct().select("cand", F.explode(segments(F.col("cand"), d)).alias("__k"))
    keys = ["__n", "__i", "__s"]
    q, c = (x.select(x.columns[0], *(F.col(f"__k.{k[2:]}").alias(k) for k in keys)) for x in (q, c))
    dist = F.levenshtein(F.col("query"), F.col("cand"), d)
    # Spark takes exploded keys for as few bytes as the words, and would broadcast them.
    return q.join(c.hint("merge"), keys).select("query", "cand", dist.alias("dist")).filter("dist >= 0").distinct()


#: Distances up to which nearest words are sought by segments; queries still short of words then meet every word.
NEAR = 2


def find_nearest(queries: DataFrame, lexicon: DataFrame, n: int = 1, furthest: int | None = None) -> DataFrame:
    """query, cand, dist, rank: the ``n`` nearest words by distance, then frequency, then word; within ``furthest``, or at any distance.

    Words within ``NEAR`` are found first. A query with ``n`` of them is settled; only the others are compared with the whole lexicon."""
    near = min(NEAR, furthest) if furthest is not None else NEAR
    met = find_within(queries, lexicon, furthest if furthest is not None else near)
    if furthest is None:
        met = saved(met, "nearest")
        settled = met.groupBy("query").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n)
        short = queries.select(F.col("word").alias("query")).distinct().join(settled, "query", "left_anti").select("query", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("__p"))
        words = lexicon.select(F.col("word").alias("cand")).distinct().withColumn("__p", F.pmod(F.xxhash64("cand"), F.lit(_PARTS)).cast("int"))
        far = short.join(words, "__p").select("query", "cand", F.levenshtein("query", "cand").alias("dist"))
        # Of each part of the lexicon only the n nearest go on.
        freq = lexicon.select(F.col("word").alias("cand"), "freq")
        best = Window.partitionBy("query", F.pmod(F.xxhash64("cand"), F.lit(_PARTS))).orderBy("dist", F.col("freq").desc(), "cand")
        far = far.join(freq, "cand").withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= n).select("query", "cand", "dist")
        met = met.join(settled, "query", "left_semi").select("query", "cand", "dist").unionByName(far)
    met = met.join(lexicon.select(F.col("word").alias("cand"), "freq"), "cand")
    order = Window.partitionBy("query").orderBy("dist", F.col("freq").desc(), "cand")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("query", "cand", "dist", "rank")


def with_code(words: DataFrame, word: str = "word") -> DataFrame:
    """word, code, over distinct words; words without a code are left out."""
    own = words.select(F.col(word).alias("word")).distinct()
    return own.withColumn("code", primary_code(remove_repetition(F.col("word")))).filter(F.col("code").isNotNull())


def phonetic_dictionary(words: DataFrame) -> DataFrame:
    """code, words (sorted)."""
    return with_code(words).groupBy("code").agg(F.array_sort(F.collect_list("word")).alias("words"))


def sounds_like(queries: DataFrame, phonetic: DataFrame, d: int) -> DataFrame:
    """query, cand: words whose code is within ``d`` of the query's."""
    coded = with_code(queries)
    near = find_within(coded.select(F.col("code").alias("word")), phonetic.select(F.col("code").alias("word")), d)
    hits = coded.join(near, coded.code == near.query).select(F.col("word").alias("__q"), F.col("cand").alias("code"))
    return hits.join(phonetic, "code").select(F.col("__q").alias("query"), F.explode("words").alias("cand"))


def confusion_set(queries: DataFrame, lexicon: DataFrame, phonetic: DataFrame | None, lexical: int = 2, phonetic_distance: int = 1) -> DataFrame:
    """query, cand, source (0 sound, 1 spelling). A multiset: a word found both ways is there twice."""
    spelt = find_within(queries, lexicon, lexical).select("query", "cand", F.lit(1).alias("source"))
    if phonetic is None:
        return spelt
    return sounds_like(queries, phonetic, phonetic_distance).withColumn("source", F.lit(0)).unionByName(spelt)


def cut(candidates: DataFrame, freqs: DataFrame, percent: int = 30) -> DataFrame:
    """The first ``percent`` (rounded down) of each query's candidates by corpus frequency; unknown words have 0."""
    known = candidates.join(freqs.select(F.col("word").alias("cand"), "freq").hint("merge"), "cand", "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("freq").desc(), "source", "cand"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query"))
    return known.withColumn("rank", rank).withColumn("__n", n).filter(F.expr(f"rank <= __n * {percent} div 100")).select("query", "cand", "source", "freq", "rank")
