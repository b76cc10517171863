from pyspark.sql import functions as F

from plainword.operators import langmodel


def test_score_under_equals_score_and_shuffles_less(spark):
    """The whole model was joined, and grams that Spark took for small were broadcast; now the grams asked for are counted along, and only they go on."""
    df = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (["b", "c"],), ([],), (["a", "b", "d"],)], "tokens array<string>")
    grams = langmodel.trigram_counts(spark.createDataFrame([(["a", "b", "c"],), (["x", "b", "c", "y"],), (["d", "z"],)], "tokens array<string>")).select("a", "b", "c")
    got = langmodel.score_under(df, grams)
    want = langmodel.score(grams, langmodel.train(df))
    rows = lambda x: sorted(x.select("a", "b", "c", F.round("logp", 9)).collect())
    assert rows(got) == rows(want) and got.count() == grams.count()
    files = {f.split("/")[-2].rpartition("-")[0] for f in got.inputFiles()}
    assert files == {"trigrams", "trigram-heads", "bigrams"}


def test_similarity_writes_one_copy_and_meets_in_rounds(spark):
    from plainword.operators import similarity

    counts = spark.createDataFrame([(w, 1, [g, g], n) for w, g, n in (("p", "a", 2), ("p", "b", 1), ("q", "a", 1), ("r", "b", 4), ("r", "c", 1))], "word string, off int, gram array<string>, cnt long")
    pairs = spark.createDataFrame([("p", "q"), ("p", "r"), ("q", "r")], "query string, cand string")
    got = similarity.similarity(pairs, counts, "dice")
    assert sorted((r.query, r.cand, round(r.score, 6)) for r in got.collect()) == [("p", "q", round(2 / 3, 6)), ("p", "r", 0.5)]
    saved = {f.split("/")[-2].rpartition("-")[0] for f in got.inputFiles()}
    assert "context-values" not in saved and "similarity-sums" in saved
