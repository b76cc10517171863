"""Contexts of tokens: neighbours, n-grams, and the features that training counts. Tokens come as (ids, pos, tok), or whole texts as (ids, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved


def _offsets(width: int) -> list[int]:
    return [k for k in range(-width, width + 1) if k]


def shifted(df: DataFrame, ids: list[str], others: Column, shifts: list[tuple[int, int]], out: str) -> DataFrame:
    """ids, pos, tok, off, ``out``: each of ``tokens`` beside what stands ``shift`` places from it in ``others``, for each (off, shift).

    Arrays are laid side by side within a row: texts are dealt out once, and no token is. Texts that share their ids meet each other; null ids meet nothing."""
    own = df.select(*ids, F.struct(F.col("tokens").alias("t"), others.alias("o")).alias("__s")).dropna(subset=ids).groupBy(*ids).agg(F.collect_list("__s").alias("__s"))
    pairs = own.select(*ids, "__s", F.explode("__s.t").alias("__t")).select(*ids, "__t", F.explode("__s.o").alias("__o"))
    each = F.explode(F.array(*(F.struct(F.lit(off).alias("off"), F.lit(k).alias("k")) for off, k in shifts)))
    first = F.greatest(F.lit(0), -F.col("__k.k"))
    n = F.greatest(F.least(F.size("__t"), F.size("__o") - F.col("__k.k")) - first, F.lit(0))
    laid = pairs.select(*ids, "__t", "__o", each.alias("__k")).select(*ids, F.col("__k.off").alias("off"), first.alias("__f"), F.slice("__t", first + 1, n).alias("tok"), F.slice("__o", first + F.col("__k.k") + 1, n).alias(out))
    met = laid.select(*ids, "off", "__f", F.posexplode(F.arrays_zip("tok", out)).alias("__p", "__z"))
    return met.select(*ids, (F.col("__f") + F.col("__p")).alias("pos"), F.col("__z.tok").alias("tok"), "off", F.col(f"__z.{out}").alias(out))


def indexed_context(tokens: DataFrame, ids: list[str], width: int) -> DataFrame:
    """ids, pos, tok, off, other: each neighbour within ``width``. From flat tokens by an equi-join: every token is sent to the places it neighbours."""
    if "tokens" in tokens.columns:
        return shifted(tokens, ids, F.col("tokens"), [(k, k) for k in _offsets(width)], "other")
    offsets = F.filter(F.sequence(F.lit(-width), F.lit(width)), lambda x: x != 0)
    sent = tokens.select(*ids, F.col("tok").alias("other"), F.col("pos").alias("__at"), F.explode(offsets).alias("off")).select(*ids, "other", "off", (F.col("__at") - F.col("off")).alias("pos"))
    # Spark takes exploded rows for as many bytes as the texts, and would broadcast them.
    return tokens.join(sent.hint("merge"), [*ids, "pos"]).select(*ids, "pos", "tok", "off", "other")


def ngram_table(df: DataFrame, ids: list[str], n: int, tokens: str = "tokens") -> DataFrame:
    """ids, start, gram."""
    from ..functions.strings import ngrams

    return df.select(*ids, F.posexplode(ngrams(F.col(tokens), n)).alias("start", "gram"))


def ngram_context(tokens: DataFrame, grams: DataFrame | Column, ids: list[str], n: int, width: int) -> DataFrame:
    """ids, pos, tok, off, gram: n-grams that end ``-off`` places before a token or begin ``off`` after it, up to ``width``. Of whole texts, ``grams`` is the array of a text's."""
    if "tokens" in tokens.columns:
        return shifted(tokens, ids, grams, [(k, k if k > 0 else k - (n - 1)) for k in _offsets(width)], "gram")
    offsets = F.filter(F.sequence(F.lit(-width), F.lit(width)), lambda x: x != 0)
    to = F.when(F.col("off") < 0, F.col("start") + n - 1 - F.col("off")).otherwise(F.col("start") - F.col("off"))
    sent = grams.select(*ids, "gram", "start", F.explode(offsets).alias("off")).select(*ids, "gram", "off", to.alias("pos"))
    return tokens.join(sent.hint("merge"), [*ids, "pos"]).select(*ids, "pos", "tok", "off", "gram")


def context_counts(df: DataFrame, ids: list[str], universe: DataFrame, dictionary: DataFrame, n: int = 2, width: int = 3, tokens: str = "tokens") -> DataFrame:
    """word, off, gram, cnt, for the words of ``universe`` and n-grams of dictionary words only.

    Both lists are looked up once per token; then each text is put together again, and its n-grams and their places are found within the row. ``ids`` name a text."""
    marks = dictionary.select(F.col("word").alias("tok"), F.lit(1).alias("k"), F.lit(0).alias("u")).unionByName(universe.select(F.col("word").alias("tok"), F.lit(0).alias("k"), F.lit(1).alias("u")))
    marks = saved(marks.filter("tok IS NOT NULL").groupBy("tok").agg((F.max("k") == 1).alias("known"), (F.max("u") == 1).alias("wanted")), "marks")
    flat = df.select(*ids, F.posexplode(tokens).alias("pos", "tok")).join(marks, "tok")
    # Only marked tokens go on: a gap in the places is a token that no list has.
    own = F.struct(*(F.col(i) for i in ids))
    marked = flat.groupBy(own.alias("__id")).agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "known", "wanted"))).alias("__t"))

    def at(i: Column, k: int) -> Column:
        return F.get("__t", i + k)

    def gram(i: Column) -> Column:
        row = [at(i, k) for k in range(n)]
        whole = row[0]["known"]
        for k in range(1, n):
            whole = whole & row[k]["known"] & (row[k]["pos"] == row[0]["pos"] + k)
        return F.when(F.coalesce(whole, F.lit(False)), F.struct(row[0]["pos"].alias("start"), F.array(*(x["tok"] for x in row)).alias("gram")))

    grams = marked.withColumn("__g", F.transform("__t", lambda x, i: gram(i)))
    reach = width + n - 1

    def around(x: Column, i: Column) -> Column:
        """The n-grams near the token. Those within reach stand at most as many entries away as places."""
        near = [F.get("__g", i + k) for k in (*range(-reach, 0), *range(1, width + 1))]
        off = lambda g: F.when(g["start"] > x["pos"], g["start"] - x["pos"]).otherwise(g["start"] + (n - 1) - x["pos"])
        # Before a token, an n-gram has to end there too.
        fits = lambda g: g.isNotNull() & F.abs(off(g)).between(1, width) & ((g["start"] > x["pos"]) | (g["start"] + (n - 1) < x["pos"]))
        found = F.filter(F.array(*near), fits)
        return F.struct(x["tok"].alias("word"), F.transform(found, lambda g: F.struct(off(g).alias("off"), g["gram"].alias("gram"))).alias("near"))

    each = F.filter(F.transform("__t", lambda x, i: F.when(x["wanted"], around(x, i))), lambda x: x.isNotNull())
    flat = grams.select(F.explode(each).alias("w")).select(F.col("w.word").alias("word"), F.explode("w.near").alias("g"))
    return flat.groupBy("word", F.col("g.off").alias("off"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


def feature_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("off", "gram").agg(F.sum("cnt").alias("total"))


def positive_features(tokens: DataFrame, ids: list[str], dictionary: DataFrame, width: int = 3) -> DataFrame:
    """ids, pos, gov, dep, off: dictionary words around each token (dep), at their place from it."""
    near = indexed_context(tokens, ids, width)
    return near.join(dictionary.select(F.col("word").alias("other")), "other", "left_semi").select(*ids, "pos", F.col("other").alias("gov"), F.col("tok").alias("dep"), "off")


def negative_features(positives: DataFrame, candidates: DataFrame) -> DataFrame:
    """positives with dep replaced by each candidate of its own."""
    c = candidates.select(F.col("query").alias("dep"), "cand")
    return positives.join(c, "dep").withColumn("dep", F.col("cand")).select(*positives.columns)


def with_dependency_score(features: DataFrame, bank: DataFrame) -> DataFrame:
    return features.join(bank.select("gov", "off", "score"), ["gov", "off"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def training_features(positives: DataFrame, negatives: DataFrame, negatives_kept: str = "unseen") -> DataFrame:
    """label, gov, dep, off. ``unseen``: negatives that never occur as positives; ``seen``: only those that do."""
    seen = positives.select("gov", "dep", "off").distinct()
    kept = negatives.join(seen, ["gov", "dep", "off"], "left_anti" if negatives_kept == "unseen" else "left_semi")
    pick = lambda df, label: df.select(F.lit(label).alias("label"), "gov", "dep", "off")
    return pick(positives, True).unionByName(pick(kept, False))


def exemplars(tokens: DataFrame, ids: list[str], dictionary: DataFrame, candidates: DataFrame, width: int = 3) -> DataFrame:
    """ids, pos, gov, dep, off: the context of a token with each candidate in its place."""
    return negative_features(positive_features(tokens, ids, dictionary, width), candidates)


def libsvm_line(label, ids: list, score, score_id: int = 1):
    """``label id:value ...`` in the order of ids: the score, then indicators."""
    marks = F.transform(F.array_sort(F.array(*ids)), lambda i: F.concat(i.cast("string"), F.lit(":1")))
    return F.concat_ws(" ", F.when(label, "1").otherwise("-1"), F.concat(F.lit(f"{score_id}:"), score.cast("string")), F.array_join(marks, " "))
