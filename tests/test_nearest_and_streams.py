from pyspark.sql import functions as F

from plainword.operators.candidates import find_nearest
from plainword.streaming.streams import simple_normalise_stream


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_at_any_distance(spark):
    words = [("river", 9), ("rivers", 4), ("liver", 7), ("mountain", 5), ("fountain", 5), ("a", 3), ("extraordinary", 1)]
    queries = ["rivr", "qqqqqqqq", "extra", "mount", "a"]
    lexicon = spark.createDataFrame(words, "word string, freq long")
    got = {}
    for r in find_nearest(spark.createDataFrame([(q,) for q in queries], "word string"), lexicon, 3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.cand, r.dist))
    want = {q: [(w, d) for d, _, w in sorted((distance(q, w), -f, w) for w, f in words)[:3]] for q in queries}
    assert got == want and want["extra"][-1][1] >= 5


def test_no_pair_of_a_large_mapping_is_left_out(spark):
    mapping = spark.range(100_001).select(F.concat(F.lit("w"), "id").alias("oov"), F.concat(F.lit("n"), "id").alias("iv"))
    tweets = spark.createDataFrame([(["w0", "w100000", "other"],)], "tokens array<string>")
    none = spark.createDataFrame([], "word string")
    assert simple_normalise_stream(tweets, none, mapping).first().norm_tokens == ["n0", "n100000", "other"]
