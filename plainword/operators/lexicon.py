"""Word counts, and lexicons as tables (word, freq[, data])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import is_subsequence, is_word

#: Words that the dictionary has besides the given ones.
INCLUDED = ("retweet", "followback", "lol", "lmao", "haha", "rofl")


def exploded(df: DataFrame, ids: list[str], tokens: str = "tokens") -> DataFrame:
    """ids, pos, tok."""
    return df.select(*ids, F.posexplode(tokens).alias("pos", "tok"))


def word_count(df: DataFrame, tokens: Column) -> DataFrame:
    """word, freq, of the tokens that are words."""
    return df.select(F.explode(tokens).alias("word")).filter(is_word(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def dictionary(words: DataFrame, include: tuple[str, ...] = INCLUDED, exclude: tuple[str, ...] = ()) -> DataFrame:
    """word: given words and ``include``, without ``exclude`` and blanks."""
    more = words.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, include))).alias("word")) if include else None
    both = words.select("word").union(more) if include else words.select("word")
    return both.filter((F.col("word") != "") & ~F.col("word").isin(list(exclude))).distinct()


def stratify(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """counts with ``iv``: whether the dictionary has the word."""
    return counts.join(dictionary.select("word").distinct().withColumn("__in", F.lit(True)), "word", "left").select(*counts.columns, F.coalesce("__in", F.lit(False)).alias("iv"))


def frequent_oov(counts: DataFrame, dictionary: DataFrame, min_freq: int = 10, min_length: int = 4) -> DataFrame:
    return counts.filter((F.col("freq") >= min_freq) & (F.length("word") >= min_length)).join(dictionary.hint("merge"), "word", "left_anti")  # saved words take some twenty times their bytes when broadcast


def merge(*lexicons: DataFrame, data=None) -> DataFrame:
    """word, freq (summed), data. Without ``data``, a later lexicon's data wins over null and earlier data; ``data`` combines the list of all."""
    rows = None
    for n, lex in enumerate(lexicons):
        one = lex.select("word", "freq", "data", F.lit(n).alias("__n"))
        rows = one if rows is None else rows.unionByName(one)
    kept = F.max_by("data", F.when(F.col("data").isNotNull(), F.col("__n"))) if data is None else data(F.transform(F.array_sort(F.collect_list(F.struct("__n", "data"))), lambda x: x["data"]))
    return rows.groupBy("word").agg(F.sum("freq").alias("freq"), kept.alias("data"))


def union_data(all_data: Column) -> Column:
    return F.array_distinct(F.flatten(F.filter(all_data, lambda x: x.isNotNull())))


def insert(lexicon: DataFrame, word: str, freq: int = 0, data: list[str] | None = None) -> DataFrame:
    return merge(lexicon, lexicon.sparkSession.createDataFrame([(word, freq, data)], "word string, freq long, data array<string>"))


def delete(lexicon: DataFrame, word: str) -> DataFrame:
    return lexicon.filter(F.col("word") != word)


def prefix_frequency(lexicon: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, freq: summed over the words that begin so."""
    each = F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("word"), p))
    return lexicon.select(F.explode(each).alias("prefix"), "freq").groupBy("prefix").agg(F.sum("freq").alias("freq"))


def with_prefix(lexicon: DataFrame, s: str) -> DataFrame:
    return lexicon.filter(F.col("word").startswith(s))


def with_suffix(lexicon: DataFrame, s: str) -> DataFrame:
    return lexicon.filter(F.col("word").endswith(s))


def with_substring(lexicon: DataFrame, s: str) -> DataFrame:
    return lexicon.filter(F.col("word").contains(s))


def with_characters(lexicon: DataFrame, s: str) -> DataFrame:
    """Words that have the characters of ``s`` in order."""
    return lexicon.filter(is_subsequence(F.col("word"), s))


def unique_ids(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """key, id: dense ids in the order of the keys. Keys are counted by range first, so no task ranks all of them."""
    keys = df.select(key).distinct()
    b = keys.withColumn("__b", F.substring(F.coalesce(F.col(key).cast("string"), F.lit("")), 1, 2))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return b.withColumn("__r", rank).join(offsets, "__b").select(key, (F.col("__o") + F.col("__r") - 1 + start).cast("long").alias("id"))
