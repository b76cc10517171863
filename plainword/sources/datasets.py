"""Registry of the datasets that the normalisers need: names, file names, loaders, and checks that change nothing."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import langmodel, lexicon
from . import readers

NAMES = ("dict", "twt", "nyt", "profiles", "twt-c", "dm-dict", "nmd", "tlm", "dpb", "lksm")


def path_of(root: str, name: str) -> str:
    if name not in NAMES:
        raise ValueError(f"no dataset {name!r}")
    return f"{root.rstrip('/')}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def missing(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    return [n for n in names if not exists(spark, path_of(root, n))]


def load(spark: SparkSession, root: str, name: str, include: tuple[str, ...] = lexicon.INCLUDED, exclude: tuple[str, ...] = ()):
    at = path_of(root, name)
    if name == "dict":
        return lexicon.dictionary(readers.read_lines(spark, at, blank=False).select(F.lower("value").alias("word")), include, exclude)
    if name == "dm-dict":
        return readers.read_tsv(spark, at, ["string"], "words").select(F.col("c0").alias("code"), "words")
    if name == "nmd":
        return readers.read_tsv(spark, at, ["string", "string"]).groupBy(F.col("c0").alias("oov")).agg(F.max_by("c1", F.monotonically_increasing_id()).alias("iv"))
    if name == "dpb":
        rows = readers.read_tsv(spark, at, ["string"], "rest")
        pair = F.transform(F.sequence(F.lit(0), F.size("rest") - 2, F.lit(2)), lambda i: F.struct(F.get("rest", i).cast("int").alias("off"), F.get("rest", i + 1).cast("double").alias("score")))
        return rows.select(F.col("c0").alias("gov"), F.explode(pair).alias("p")).select("gov", "p.off", "p.score")
    if name == "tlm":
        return langmodel.Model(*(spark.read.parquet(f"{at}/{t}") for t in ("trigrams", "bigrams", "unigrams")))
    if name == "lksm":
        return PipelineModel.load(at)
    return readers.read_lines(spark, at)


def save(data, root: str, name: str) -> None:
    at = path_of(root, name)
    if name == "dm-dict":
        readers.write_tsv(data, at, ["code"], "words")
    elif name == "nmd":
        readers.write_tsv(data, at, ["oov", "iv"])
    elif name == "dpb":
        rest = F.flatten(F.array_sort(F.collect_list(F.array(F.col("off").cast("string"), F.col("score").cast("string")))))
        readers.write_tsv(data.groupBy("gov").agg(rest.alias("rest")), at, ["gov"], "rest")
    elif name == "tlm":
        for t in ("trigrams", "bigrams", "unigrams"):
            getattr(data, t).write.parquet(f"{at}/{t}")
    elif name == "lksm":
        data.write().save(at)
    else:
        data.select(F.col(data.columns[0]).alias("value")).write.text(at)


def lines_with_ids(df: DataFrame) -> DataFrame:
    """value, id; ids follow the order of the files and lines."""
    return df.withColumn("id", F.monotonically_increasing_id())
