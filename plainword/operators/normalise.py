"""Normalisers: tables with ids and an array ``tokens`` get an array ``norm_tokens``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import is_normalisable
from ..session import saved
from . import candidates, classifier, context, langmodel, ranking


def _flat(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.select(*ids, F.posexplode("tokens").alias("pos", "tok"))


def _rebuilt(df: DataFrame, ids: list[str], changed: DataFrame) -> DataFrame:
    """changed: ids, pos, new, only for the tokens that change; their texts alone are gathered."""
    marks = changed.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("__new"))
    new = F.transform("tokens", lambda x, i: F.coalesce(F.try_element_at(F.col("__new"), i), x))
    return df.join(marks, ids, "left").withColumn("norm_tokens", F.when(F.col("__new").isNull(), F.col("tokens")).otherwise(new)).drop("__new")


def simple_normalise(df: DataFrame, ids: list[str], dictionary: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tokens outside the dictionary become what ``mapping`` (oov, iv) gives for them, if anything."""
    unknown = mapping.join(dictionary.select(F.col("word").alias("oov")), "oov", "left_anti")
    return _rebuilt(df, ids, _flat(df, ids).join(unknown.select(F.col("oov").alias("tok"), F.col("iv").alias("new")), "tok").select(*ids, "pos", "new"))


@dataclass
class Models:
    dictionary: DataFrame
    phonetic: DataFrame | None
    lm: langmodel.Model
    bank: DataFrame
    classifier: PipelineModel
    lexical: int = 2
    phonetic_distance: int = 1
    percent: int = 10
    least: int = 1
    use_score: bool = True
    mapping: DataFrame | None = field(default=None)


def complex_normalise(df: DataFrame, ids: list[str], m: Models) -> DataFrame:
    """Unknown words become the best of their candidates where the classifier finds a candidate that fits the context of the original tokens better.

    Candidates are made once for each distinct word. The language model keeps the first ``percent`` of them (rounded down, so few candidates give none)."""
    keys = [*ids, "pos"]
    flat = _flat(df, ids)
    oov = flat.filter(is_normalisable(F.col("tok"))).join(m.dictionary.select(F.col("word").alias("tok")), "tok", "left_anti")
    found = candidates.confusion_set(oov.select(F.col("tok").alias("word")), m.dictionary, m.phonetic, m.lexical, m.phonetic_distance)
    around = context.indexed_context(oov_context(flat, oov, ids), ids, 1)
    left = around.filter("off = -1").select(*keys, F.col("other").alias("left"))
    right = around.filter("off = 1").select(*keys, F.col("other").alias("right"))
    each = oov.join(found.select(F.col("query").alias("tok"), "cand"), "tok").join(left, keys, "left").join(right, keys, "left")
    ranked = saved(langmodel.lm_ranked(saved(each, "candidates"), m.lm, keys), "ranked")
    n = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    kept = saved(ranked.join(n, keys).filter(F.expr(f"rank <= __n * {m.percent} div 100")).select(*keys, F.col("tok").alias("query"), "cand"), "kept")
    near = context.positive_features(flat, ids, m.dictionary).select(*keys, "gov", "off")
    features = context.with_dependency_score(kept.distinct().join(near, keys).withColumn("dep", F.col("cand")), m.bank)
    votes = ranking.predict_vote(classifier.predict(m.classifier, features, m.use_score), [*keys, "cand"], "pred")
    ill = ranking.ill_formed(votes, keys, m.least).filter("ill")
    best = ranking.choose_candidate(kept.join(ill.select(*keys), keys, "left_semi"), keys)
    return _rebuilt(df, ids, best.select(*keys, F.col("cand").alias("new")))


def oov_context(flat: DataFrame, oov: DataFrame, ids: list[str]) -> DataFrame:
    """The tokens of texts that have an unknown word; others need no context."""
    return flat.join(oov.select(*ids).distinct(), ids, "left_semi")


def duplex_normalise(df: DataFrame, ids: list[str], m: Models) -> DataFrame:
    """Simple, then complex on what that gives."""
    first = simple_normalise(df, ids, m.dictionary, m.mapping).withColumn("tokens", F.col("norm_tokens")).drop("norm_tokens")
    out = complex_normalise(first, ids, m).select(*ids, "norm_tokens")
    return df.join(out, ids)


class Normaliser(Transformer):
    """``transform`` adds norm_tokens, by the strategy simple, complex or duplex."""

    def __init__(self, strategy: str, ids: list[str], models: Models | None = None, dictionary: DataFrame | None = None, mapping: DataFrame | None = None):
        super().__init__()
        if strategy not in ("simple", "complex", "duplex"):
            raise ValueError(f"no strategy {strategy!r}")
        self.strategy, self.ids, self.models = strategy, ids, models
        self.dictionary, self.mapping = dictionary if dictionary is not None else models.dictionary, mapping if mapping is not None else (models.mapping if models else None)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.strategy == "simple":
            return simple_normalise(dataset, self.ids, self.dictionary, self.mapping)
        return {"complex": complex_normalise, "duplex": duplex_normalise}[self.strategy](dataset, self.ids, self.models)
