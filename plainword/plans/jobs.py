"""Jobs: cleaning, the six trainings, bootstrap and batch normalisation, over datasets in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import word_tokens
from ..functions.tweet_tokens import tweet_tokens_lower
from ..operators import candidates, classifier, clean, context, depbank, langmodel, lexicon, normalise, similarity
from ..session import saved
from ..sources import datasets, readers
from .config import Config


def _tweets(spark: SparkSession, c: Config, name: str) -> DataFrame:
    """id, text, tokens."""
    return datasets.lines_with_ids(readers.read_lines(spark, datasets.path_of(c.data, name), blank=False)).select("id", F.col("value").alias("text"), tweet_tokens_lower(F.col("value")).alias("tokens"))


def _dict(spark: SparkSession, c: Config) -> DataFrame:
    return datasets.load(spark, c.data, "dict", tuple(c.dict_include), tuple(c.dict_exclude))


def train_twt_c(spark: SparkSession, c: Config) -> DataFrame:
    return clean.clean_lines(_tweets(spark, c, "twt"), ["id"], _dict(spark, c), "tokens").select("text")


def train_dm_dict(spark: SparkSession, c: Config) -> DataFrame:
    return candidates.phonetic_dictionary(_dict(spark, c))


def normalisation_pairs(tweets: DataFrame, ids: list[str], dictionary: DataFrame, phonetic: DataFrame | None, c: Config) -> DataFrame:
    """oov, iv, ranked best first. tweets: ids, tokens."""
    counts = saved(lexicon.word_count(tweets, F.col("tokens")), "word-counts")
    oov = lexicon.frequent_oov(counts, dictionary, c.nmd_min_freq, c.nmd_min_length)
    freqs = counts.join(dictionary, "word", "left_semi")
    kept = candidates.cut(candidates.confusion_set(oov, dictionary, phonetic, c.lex_dist, c.phon_dist), freqs, c.nmd_cutoff)
    pairs = saved(kept.select("query", "cand").distinct(), "pairs")
    universe = pairs.select(F.col("query").alias("word")).union(pairs.select("cand")).distinct()
    counted = context.context_counts(tweets, ids, universe, dictionary, c.nmd_order, c.nmd_window)
    best = saved(similarity.best_pair(similarity.similarity(pairs, counted, c.nmd_measure)), "best-pairs")
    return similarity.ranked_pairs(best, c.nmd_pairs).select(F.col("query").alias("oov"), F.col("cand").alias("iv"))


def train_nmd(spark: SparkSession, c: Config) -> DataFrame:
    return normalisation_pairs(_tweets(spark, c, "twt"), ["id"], _dict(spark, c), datasets.load(spark, c.data, "dm-dict"), c)


def train_tlm(spark: SparkSession, c: Config) -> langmodel.Model:
    return langmodel.train(_tweets(spark, c, "twt-c"))


def train_dpb(spark: SparkSession, c: Config) -> DataFrame:
    s = depbank.read_sentences(spark, datasets.path_of(c.data, "nyt"), "nyt*")
    if c.dpb_num_sents is not None:
        s = s.limit(c.dpb_num_sents)
    return depbank.dependency_frequency(depbank.untyped_dependencies(s, _dict(spark, c)))


def fit_features(tweets: DataFrame, ids: list[str], dictionary: DataFrame, phonetic: DataFrame | None, lm: langmodel.Model, bank: DataFrame, c: Config) -> DataFrame:
    """label, gov, dep, off, score: each dictionary word in context, and its likeliest confusions in its place."""
    keys = [*ids, "pos"]
    flat = tweets.select(*ids, F.posexplode("tokens").alias("pos", "tok"))
    known = flat.join(dictionary.select(F.col("word").alias("tok")), "tok", "left_semi")
    found = candidates.confusion_set(known.select(F.col("tok").alias("word")), dictionary, phonetic, c.lex_dist, c.phon_dist).select("query", "cand").distinct()
    near = context.indexed_context(flat, ids, 1)
    side = lambda off, name: near.filter(F.col("off") == off).select(*keys, F.col("other").alias(name))
    each = known.join(found.select(F.col("query").alias("tok"), "cand"), "tok").join(side(-1, "left"), keys, "left").join(side(1, "right"), keys, "left")
    top = langmodel.lm_ranked(each, lm, keys).filter(F.col("rank") <= c.lksm_num_candidates).filter("cand <> tok").select(*keys, "cand")
    positives = context.positive_features(flat, ids, dictionary).join(dictionary.select(F.col("word").alias("dep")), "dep", "left_semi")
    negatives = positives.join(top, keys).withColumn("dep", F.col("cand")).select(*positives.columns)
    return context.with_dependency_score(context.training_features(positives, negatives, c.lksm_negatives), bank)


def train_lksm(spark: SparkSession, c: Config):
    tweets = _tweets(spark, c, "twt-c").orderBy("id").limit(c.lksm_num_tweets)
    f = fit_features(tweets, ["id"], _dict(spark, c), datasets.load(spark, c.data, "dm-dict"), datasets.load(spark, c.data, "tlm"), datasets.load(spark, c.data, "dpb"), c)
    return classifier.train(f, c.lksm_solver, c.lksm_c, c.lksm_eps, c.lksm_use_score)


TRAININGS = {"twt-c": train_twt_c, "dm-dict": train_dm_dict, "nmd": train_nmd, "tlm": train_tlm, "dpb": train_dpb, "lksm": train_lksm}


def train(spark: SparkSession, name: str, c: Config) -> None:
    if name not in TRAININGS:
        raise ValueError(f"no training {name!r}")
    datasets.save(TRAININGS[name](spark, c), c.data, name)


def bootstrap(spark: SparkSession, c: Config) -> None:
    for name in TRAININGS:
        train(spark, name, c)


def models(spark: SparkSession, c: Config) -> normalise.Models:
    load = lambda name: datasets.load(spark, c.data, name)
    return normalise.Models(_dict(spark, c), load("dm-dict"), load("tlm"), load("dpb"), load("lksm"), c.lex_dist, c.phon_dist, c.post_rank_cutoff, 1, c.lksm_use_score, load("nmd") if c.strategy == "duplex" else None)


def batch(spark: SparkSession, source: str, target: str | None, c: Config) -> None:
    """Reads ``source``, adds norm_tokens and writes them, by default to ``source``.norm."""
    read = {"raw": readers.read_raw, "tkn": readers.read_tkn, "json": readers.read_json}[c.input_format]
    tweets = datasets.lines_with_ids(read(spark, source))
    if c.strategy == "simple":
        out = normalise.simple_normalise(tweets, ["id"], _dict(spark, c), datasets.load(spark, c.data, "nmd"))
    else:
        out = normalise.Normaliser(c.strategy, ["id"], models(spark, c)).transform(tweets)
    readers.write_encoded(out, c.output_format, target or f"{source}.norm")


def clean_job(spark: SparkSession, source: str, target: str, c: Config) -> None:
    lines = datasets.lines_with_ids(readers.read_lines(spark, source)).withColumnRenamed("value", "text")
    kept = clean.clean(lines, list(c.clean_filters), duplicates={"order": ["id"]})
    kept.select(F.col("text").alias("value")).write.text(target)


__all__ = ["batch", "bootstrap", "clean_job", "models", "normalisation_pairs", "train", "word_tokens"]
