"""Cleaning filters. Each takes and gives a table with an id and a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import canonical_key, is_punctuation, remove_punct_repetition

# Frequent words that tell English texts from others where no language column does.
_ENGLISH = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "at", "this", "by", "i", "you", "not", "are", "have")
_OTHER = ("de", "la", "que", "el", "en", "les", "des", "et", "le", "der", "die", "und", "das", "los", "un", "une", "est", "ist", "von", "zu", "por", "con")


def english(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """By the language column if given; else rows with more English than other frequent words."""
    if lang:
        return df.filter(F.col(lang) == "en")
    own = F.split(F.lower(F.col(text)), r"[^\p{L}']+")
    hits = lambda known: F.size(F.filter(own, lambda x: x.isin(list(known))))
    return df.filter(hits(_ENGLISH) > hits(_OTHER))


def without_duplicates(df: DataFrame, order: list[str], text: str = "text", least: int = 3, collapse: bool = True) -> DataFrame:
    """The first row (by ``order``) of those with the same key: the first four letters of each word. Texts with fewer than ``least`` words go.

    The first row of a key is found by a minimum, which is taken on each side of the shuffle, so a key with very many rows is no burden."""
    keyed = df.withColumn("__k", canonical_key(F.col(text), collapse)).filter(F.size("__k") >= least)
    keyed = keyed.withColumn("__h", F.sha2(F.array_join("__k", " ").cast("binary"), 256)).drop("__k")
    first = keyed.groupBy("__h").agg(F.min(F.struct(*order)).alias("__first"))
    met = keyed.join(first, "__h").filter(F.struct(*order) == F.col("__first"))
    return met.withColumn("__r", F.row_number().over(Window.partitionBy("__h").orderBy(*order))).filter("__r = 1").drop("__h", "__first", "__r")


FILTERS = {"english": english, "duplicates": without_duplicates}


def clean(df: DataFrame, names: list[str], **settings: dict) -> DataFrame:
    """The named filters in the order given; later ones see only what earlier ones kept."""
    unknown = [n for n in names if n not in FILTERS]
    if unknown:
        raise ValueError(f"no filter {unknown[0]!r}")
    return reduce(lambda d, n: FILTERS[n](d, **settings.get(n, {})), names, df)


def clean_corpus(df: DataFrame, ids: list[str], dictionary: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rows all of whose tokens are dictionary words or punctuation. Rows without tokens are clean."""
    dirty = df.select(*ids, F.explode(tokens).alias("word")).filter(~is_punctuation(F.col("word"))).join(dictionary.select("word"), "word", "left_anti")
    return df.join(dirty.select(*ids).distinct(), ids, "left_anti")


def clean_lines(df: DataFrame, ids: list[str], dictionary: DataFrame, tokens: str, text: str = "text") -> DataFrame:
    return clean_corpus(df, ids, dictionary, tokens).withColumn(text, remove_punct_repetition(F.lower(F.col(text))))
