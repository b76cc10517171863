"""Quality classifier: gradient-boosted trees on histograms of document statistics.

``statistics`` are native expressions over the text alone. ``Boosted.fit`` trains on binned statistics of a bounded sample of labelled rows; the trees are complete
and stored as flat arrays, so ``Boosted.score`` walks all rows of a batch down a tree at once.

Null text counts as empty; empty texts get a score like any others. Rows are scored one by one, so ties, repeats and null ids pass through (a null id
is never labelled, and not held out). Several labels of one id count as their mean, 1 from a half up; null labels don't count. Without labels every score is 0.5.
Labels, language, source and ids are no inputs. Only the named columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_of, words

#: Labelled rows to learn from, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20000
#: Statistics of a document.
WIDTH = 14


def statistics(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: an array of the document's statistics."""
    t = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    t = t.withColumn("__w", words(F.col("__t"))).withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)))
    text, n = F.col("__t"), F.size("__w")
    t = t.withColumns({
        "__n": n.cast("double"), "__c": F.length("__t").cast("double"), "__lines": F.size("__l").cast("double"),
        "__letters": count_of(text, r"\p{L}").cast("double"),
        "__distinct": F.size(F.array_distinct(F.transform("__w", lambda x: F.lower(x)))).cast("double"),
    })
    per = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    n, c = F.col("__n"), F.col("__c")
    values = [
        F.log1p(n), per(F.col("__letters"), n), per(F.col("__letters"), c),
        per(count_of(text, r"\p{Lu}").cast("double"), F.col("__letters")),
        per(count_of(text, "0-9").cast("double"), c),
        per(count_of(text, "#*$%&|<>{}\\[\\]\\\\^~_=+@/").cast("double"), c),
        per(count_of(text, "!?").cast("double"), n), per(count_of(text, ".,;:").cast("double"), n),
        per(F.col("__distinct"), n), per(F.log1p(F.col("__distinct")), F.log1p(n)),
        per(n, F.col("__lines")), per(F.size(F.array_distinct("__l")).cast("double"), F.col("__lines")),
        per(F.size(F.filter("__w", lambda x: x.rlike(r"^[\p{L}'’-]+[.,;:!?]?$"))).cast("double"), n),
        F.coalesce(F.array_max(F.transform("__w", lambda x: F.length(x))).cast("double"), F.lit(0.0)),
    ]
    return t.withColumn(out, F.array(*values)).drop("__t", "__w", "__l", "__n", "__c", "__lines", "__letters", "__distinct")


@dataclass
class Boosted:
    """feature and cut: (trees, 2**depth - 1), node i with children 2i+1 (value <= cut) and 2i+2; leaf: (trees, 2**depth)."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Boosted:
        n, width = x.shape if len(x) else (0, 1)
        nodes = 2**depth - 1
        out = cls(0.0, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)))
        if n == 0 or y.min() == y.max():
            out.start = 0.0 if n == 0 else float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
            return out
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(width)]
        code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)  # code <= b  <=>  value <= cuts[b]
        flat = code + np.arange(width) * bins
        mean = y.mean()
        out.start = float(np.log(mean / (1 - mean)))
        raw = np.full(n, out.start)
        for k in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (width * bins) + flat).ravel()
                size = count * width * bins
                gs = np.bincount(key, np.repeat(g, width), size).reshape(count, width, bins).cumsum(2)
                hs = np.bincount(key, np.repeat(h, width), size).reshape(count, width, bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for i in range(count):
                    f, b = divmod(int(best[i]), bins)
                    if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                        out.feature[k, first + i], out.cut[k, first + i] = f, cuts[f][b]
                f = out.feature[k, at]
                at = 2 * at + 1 + (x[np.arange(n), f] > out.cut[k, at])
            slot = at - nodes
            out.leaf[k] = rate * np.bincount(slot, g, nodes + 1) / (np.bincount(slot, h, nodes + 1) + ridge)
            raw += out.leaf[k, slot]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows, nodes = np.full(len(x), self.start), np.arange(len(x)), self.cut.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while nodes and len(at) and at[0] < nodes:  # all rows stand on the same level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += leaf[at - nodes]
        return 1 / (1 + np.exp(-raw))


def held_out(id_col: Column) -> Column:
    """Whether the id's CRC-32, as text, leaves the remainder 1 by 3. Such rows are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Boosted:
    """Learns from at most ``rows`` labelled rows that aren't held out; their ids (not more) are broadcast, their statistics gathered."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("double").alias("__y"))
    some = one.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id")
    got = statistics(known, "__text", "__f").select("__id", "__y", "__f").orderBy("__id").limit(2 * rows).toPandas()
    x = np.array(got["__f"].tolist(), np.float64).reshape(len(got), WIDTH)
    return Boosted.fit(x, got["__y"].to_numpy(np.float64))


def with_score(df: DataFrame, model: Boosted, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the score of each text, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in batches:
            yield pd.Series(m.score(np.array(s.tolist(), np.float64).reshape(len(s), WIDTH)))

    return statistics(df, text_col, "__f").withColumn(out, score("__f")).drop("__f")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5)."""
    model = train(docs, labels, id_col, text_col, label_col, rows)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    scored = with_score(narrow, model, "__text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **settings) -> DataFrame:
    """``docs`` without the rows that score below ``least``."""
    model = train(docs, labels, id_col, text_col, **settings)
    return with_score(docs, model, text_col, "__score").filter(F.col("__score") >= least).select(*docs.columns)
