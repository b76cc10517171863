"""Contexts are made within the rows of texts: no exploded table is broadcast or dealt out."""

import pytest
from pyspark.sql import functions as F

from plainword.operators import context

#: Texts that share ids, an empty one, ids that are null, and words that repeat.
TEXTS = [(1, 1, ["a", "b", "c", "a", "d"]), (1, 1, ["x", "y"]), (1, 2, []), (2, 1, ["z"]), (None, 1, ["n", "m"]), (3, None, ["n", "m"]), (4, 1, list("abcdefgh"))]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "x long, y long, tokens array<string>")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_neighbours_without_a_join(texts):
    flat = texts.select("x", "y", F.posexplode("tokens").alias("pos", "tok"))
    for width in (1, 2, 9):
        got = context.indexed_context(texts, ["x", "y"], width)
        assert "Join" not in plan(got)
        assert rows(got) == rows(context.indexed_context(flat, ["x", "y"], width))
    assert "BroadcastExchange" not in plan(context.indexed_context(flat, ["x", "y"], 2))


def test_ngrams_without_a_join(texts):
    from plainword.functions.strings import join_tokens, joined_ngrams

    flat = texts.select("x", "y", F.posexplode("tokens").alias("pos", "tok"))
    for n, width in ((1, 1), (2, 2), (3, 4)):
        grams = context.ngram_table(texts, ["x", "y"], n).withColumn("gram", join_tokens(F.col("gram")))
        got = context.ngram_context(texts, joined_ngrams(F.col("tokens"), n), ["x", "y"], n, width)
        assert "Join" not in plan(got)
        assert rows(got) == rows(context.ngram_context(flat, grams, ["x", "y"], n, width)), (n, width)


def test_features_deal_out_no_token(texts, spark, tmp_path):
    """positive_features and what builds on it (negative_features, libsvm_encode) look words up, but join no exploded table with another."""
    flat = texts.select("x", "y", F.posexplode("tokens").alias("pos", "tok"))
    known = spark.createDataFrame([(w,) for w in "abdxn"], "word string")
    got = context.positive_features(texts, ["x", "y"], known)
    assert rows(got) == rows(context.positive_features(flat, ["x", "y"], known))


@pytest.mark.parametrize("name", ["positive_features", "negative_features", "libsvm_encode"])
def test_no_exploded_table_is_broadcast(spark, name):
    from plainword.plans import queries

    text = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    #: Tokens of the conversations may stand below a join's streamed side only: under no broadcast are they exploded twice.
    for part in text.split("BroadcastExchange")[1:]:
        below = part.split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        own = [x for x in below[1:] if x.strip()]
        inside = []
        for x in own:
            if inside and depth(x) < depth(inside[0]):
                break
            inside.append(x)
        assert not any("posexplode(" in x for x in inside), name


def test_candidates_are_never_broadcast(spark):
    """The keys that words are sought by were broadcast: 88 MB over 0.1 GB of texts."""
    from plainword.operators import candidates, lexicon

    counts = spark.createDataFrame([("means", 20), ("beans", 10), ("beats", 15), ("meanies", 9)], "word string, freq long")
    found = candidates.find_within(counts, counts, 1)
    assert ("means", "beans", 1) in {tuple(r) for r in found.collect()}
    known = counts.select("word").filter("freq > 10")
    for df in (found, candidates.cut(found.withColumn("source", F.lit(1)), counts), lexicon.frequent_oov(counts, known)):
        assert "Broadcast" not in plan(df)
