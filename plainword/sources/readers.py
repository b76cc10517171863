"""Readers and writers of short texts, and their parsers on a column ``value``. Compression follows from file names (.gz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tweet_tokens import tweet_tokens, tweet_tokens_lower


def parse_raw(lines: DataFrame) -> DataFrame:
    """value -> text (as it is) and tokens (of the lower-cased line); other columns stay."""
    return lines.withColumn("tokens", tweet_tokens_lower(F.col("value"))).withColumnRenamed("value", "text")


def parse_tkn(records: DataFrame) -> DataFrame:
    """value (a record: one token a line) -> tokens, lower-case, and text. Empty records go, so a run of blank lines is one boundary."""
    tokens = F.filter(F.split(F.lower("value"), "\n"), lambda x: x != "")
    return records.withColumn("tokens", tokens).filter(F.size("tokens") > 0).withColumn("text", F.array_join("tokens", " ")).drop("value")


def parse_json(lines: DataFrame, tokenise=tweet_tokens) -> DataFrame:
    """value (an object) -> text and tokens; what is missing follows from the other. An object with neither raises."""
    v = F.from_json("value", "struct<text: string, tokens: array<string>>", {"allowNumericLeadingZeros": "true"})
    j = lines.withColumn("__j", v)
    text, tokens = F.col("__j.text"), F.col("__j.tokens")
    neither = F.raise_error(F.lit("a record needs text or tokens"))
    out = j.withColumn("text", F.when(text.isNull() & tokens.isNull(), neither.cast("string")).otherwise(F.coalesce(text, F.array_join(tokens, " "))))
    return out.withColumn("tokens", F.coalesce(tokens, tokenise(F.lower(text)))).drop("__j", "value")


def parse_tsv(lines: DataFrame, kinds: list[str], rest: str | None = None) -> DataFrame:
    """Columns c0, c1, ... cast to ``kinds`` (a bad number raises), and ``rest``: an array of what follows. Blank lines go."""
    parts = F.split("value", "\t", -1)
    cols = [F.get(parts, F.lit(i)).cast(k).alias(f"c{i}") for i, k in enumerate(kinds)]
    more = [F.slice(parts, len(kinds) + 1, F.greatest(F.size(parts) - len(kinds), F.lit(0))).alias(rest)] if rest else []
    return lines.filter(F.col("value") != "").select(*[c for c in lines.columns if c != "value"], *cols, *more)


def read_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    lines = spark.read.text(path)
    return lines if blank else lines.filter("value <> ''")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return parse_raw(read_lines(spark, path))


def read_tkn(spark: SparkSession, path: str) -> DataFrame:
    return parse_tkn(spark.read.option("lineSep", "\n\n").text(path))


def read_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """An object a line; ``whole``: a list of objects in each file."""
    if whole:
        v = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<text: string, tokens: array<string>>>", {"allowNumericLeadingZeros": "true"})).alias("o"))
        return parse_json(v.select(F.to_json("o").alias("value")))
    return parse_json(read_lines(spark, path, blank=False))


def read_tsv(spark: SparkSession, path: str, kinds: list[str], rest: str | None = None) -> DataFrame:
    return parse_tsv(read_lines(spark, path), kinds, rest)


def encode(kind: str, tokens: Column, text: Column | None = None, norm: Column | None = None) -> Column:
    """One record as raw (tokens with spaces), tkn (a token a line and a blank line) or json."""
    if kind == "raw":
        return F.array_join(tokens, " ")
    if kind == "tkn":
        return F.concat(F.array_join(F.transform(tokens, lambda x: F.concat(x, F.lit("\n"))), ""))
    if kind == "json":
        fields = [c for c in (text.alias("text") if text is not None else None, tokens.alias("tokens"), norm.alias("norm_tokens") if norm is not None else None) if c is not None]
        return F.to_json(F.struct(*fields))
    raise ValueError(f"no format {kind!r}")


def write_encoded(df: DataFrame, kind: str, path: str, gzip: bool = False) -> None:
    """df: tokens, norm_tokens[, text]."""
    value = encode(kind, F.col("tokens" if kind == "json" else "norm_tokens"), F.col("text") if kind == "json" and "text" in df.columns else None, F.col("norm_tokens") if kind == "json" else None)
    df.select(value.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, rest: str | None = None, gzip: bool = False) -> None:
    """Tabs and line ends in values are not escaped."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (columns or df.columns)] + ([F.array_join(rest, "\t")] if rest else [])
    df.select(F.concat_ws("\t", *cols).alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)
