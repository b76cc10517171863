"""A case for each kind of token that stays whole; the texts are our own."""

from pyspark.sql import functions as F

from plainword.functions.tweet_tokens import PATTERNS, tweet_tokens

CASES = {
    "heart": ("love it <3 not </3", ["love", "it", "<3", "not", "</3"]),
    "url": ("at http://p.example/q?r=1, www.z.org and foo.ca/x or bar.com.", ["at", "http://p.example/q?r=1", ",", "www.z.org", "and", "foo.ca/x", "or", "bar.com", "."]),
    "email": ("ask me.too@mail.example.org now", ["ask", "me.too@mail.example.org", "now"]),
    "time": ("from 7:15 to 19:30:05", ["from", "7:15", "to", "19:30:05"]),
    "grouped_number": ("about 12,345,678 of them", ["about", "12,345,678", "of", "them"]),
    "joined_number": ("on 3/4/99 for $12.50 or 7.5%", ["on", "3/4/99", "for", "$12.50", "or", "7.5%"]),
    "emoticon": ("good :-) bad :( odd (: hm o_O yes (^_^)", ["good", ":-)", "bad", ":(", "odd", "(:", "hm", "o_O", "yes", "(^_^)"]),
    "arrow": ("here --> there <- back →", ["here", "-->", "there", "<-", "back", "→"]),
    "entity": ("left &zzz; so", ["left", "&zzz;", "so"]),
    "abbreviation": ("the U.K. by Dr. Who at 5 p.m. sharp", ["the", "U.K.", "by", "Dr.", "Who", "at", "5", "p.m.", "sharp"]),
    "inner_apostrophe": ("don't we’ll", ["don't", "we’ll"]),
    "marks": ("what?! wait... no: yes", ["what", "?!", "wait", "...", "no", ":", "yes"]),
    "separator": ("this--that ~ a=b", ["this", "--", "that", "~", "a", "=", "b"]),
    "decoration": ("song♫♪ star★", ["song", "♫♪", "star", "★"]),
    "hashtag": ("see #one_two now", ["see", "#one_two", "now"]),
    "mention": ("hi @some_one!", ["hi", "@some_one", "!"]),
    "edges": ('("quoted" words) [here]', ["(", '"', "quoted", '"', "words", ")", "[", "here", "]"]),
    "plain": ("  two   words ", ["two", "words"]),
    "doubly escaped": ("a &amp;amp; b", ["a", "&", "b"]),
    "empty": ("", []),
}


def test_each_kind(spark):
    assert set(PATTERNS) <= set(CASES)
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "kind string, text string")
    got = {r.kind: r.tokens for r in df.select("kind", tweet_tokens(F.col("text")).alias("tokens")).collect()}
    wrong = {k: (got[k], want) for k, (_, want) in CASES.items() if got[k] != want}
    assert not wrong
