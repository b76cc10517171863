import pytest
from pyspark.sql import functions as F

from plainword.functions import strings as S
from plainword.functions.metaphone import double_metaphone
from plainword.functions.tweet_tokens import tweet_tokens


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_metrics(spark):
    pairs = [("stone", "store"), ("river", "cloud"), ("plant", "play"), ("amber", "amber"), ("seas", "teas"), ("garden", "garden"), ("lake", "le"), ("boats", "oats"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = {(r.a, r.b): tuple(r)[2:] for r in df.select("a", "b", S.levenshtein(a, b), S.common_prefix_length(a, b), S.common_suffix_length(a, b), S.longest_common_subsequence(a, b)).collect()}
    assert got["stone", "store"][0] == 1 and got["river", "cloud"] == (5, 0, 0, 0)
    assert got["plant", "play"][1] == 3 and got["amber", "amber"][1] == 5
    assert got["seas", "teas"][2] == 3 and got["garden", "garden"][2] == 6
    assert got["lake", "le"][3] == 2 and got["boats", "oats"][3] == 4 and got["", "x"] == (1, 0, 0, 0)


def test_repetition(spark):
    got = one(spark, S.remove_repetition(F.lit("papapapapa")), S.remove_repetition(F.lit("sooooo goooood")), S.remove_punct_repetition(F.lit("nooooo!!!!!!!")))
    assert got == ("papa", "sooo goood", "nooooo!!!")


def test_tokens(spark):
    got = one(spark, S.word_tokens(F.lit("good day @you, it's ok #fine now")), tweet_tokens(F.lit("some words")), tweet_tokens(F.lit("more words!")), tweet_tokens(F.lit("see http://a.com/b :) &amp;amp; @you #tag")))
    assert got[0] == ["good", "day", "it's", "ok", "now"]
    assert got[1] == ["some", "words"] and got[2] == ["more", "words", "!"]
    assert "http://a.com/b" in got[3] and "@you" in got[3] and "#tag" in got[3] and "&" in got[3]


def test_context(spark):
    t = F.array(*map(F.lit, "abcd"))
    got = one(spark, S.context_left(t, 2, F.lit(2)), S.context_left(t, 1, F.lit(0)), S.context_right(t, 2, F.lit(1)), S.context_right(t, 1, F.lit(3)), S.ngrams(t, 3), S.ngrams(t, 5))
    assert got == (["a", "b"], [], ["c", "d"], [], [["a", "b", "c"], ["b", "c", "d"]], [])


def test_metaphone_matches_commons_codec(spark):
    java = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    for w in ["smith", "knight", "phone", "thumb", "jose", "night", "bananas", "character", "school", "wright", "laugh", "caesar", "gnome", "xylophone", "tomorrow", "judge"]:
        assert double_metaphone(w) == java.doubleMetaphone(w), w
    assert double_metaphone("") is None


@pytest.mark.parametrize("n, k, left", [(20, 20, 4), (20, 0, 0), (20, 100, 20)])
def test_take_percent(spark, n, k, left):
    from plainword.operators.ranking import take_percent

    assert take_percent(spark.range(n), k, [F.col("id")]).count() == left
