from pyspark.sql import functions as F

from plainword.operators import candidates, clean, context, lexicon, normalise, ranking
from plainword.sources import readers


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_find_within_and_nearest(spark):
    lex = spark.createDataFrame([("plate", 10), ("slate", 15), ("planet", 32), ("elephant", 923)], "word string, freq long")
    assert {r.cand for r in candidates.find_within(words(spark, "plane"), lex, 2).collect()} == {"plate", "slate", "planet"}
    assert candidates.find_nearest(words(spark, "plane"), lex).first().cand == "planet"
    got = [r.cand for r in candidates.find_nearest(words(spark, "planes"), lex, 3).orderBy("rank").collect()]
    assert got[:2] == ["planet", "plate"] and len(got) == 3


def test_find_within_equals_plain_join(spark):
    import random

    rng = random.Random(3)
    vocab = sorted({"".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randint(0, 7))) for _ in range(90)} | {"a" * 30, "a" * 29 + "b", "ba" * 15})
    df = words(spark, *vocab, None)
    plain = df.select(F.col("word").alias("a")).crossJoin(df.select(F.col("word").alias("b"))).select("a", "b", F.levenshtein("a", "b").alias("n")).collect()
    for d in (0, 1, 2, 3):
        got = [(r.query, r.cand, r.dist) for r in candidates.find_within(df, df, d).collect()]
        assert sorted(got) == sorted((r.a, r.b, r.n) for r in plain if r.n is not None and r.n <= d), d


def test_confusion_set(spark):
    lex, phon = words(spark, "plate", "planet", "garden"), spark.createDataFrame([("PLNT", ["planet", "plant"])], "code string, words array<string>")
    cs = lambda d: {r.cand for r in candidates.confusion_set(words(spark, "plane"), lex, phon, 1, d).collect()}
    assert cs(0) == {"plate", "planet"} and cs(1) == {"plate", "planet", "plant"}


def test_simple_normalise(spark):
    df = spark.createDataFrame([(1, ["see", "you", "tmrw", "u", "."]), (2, [])], "id long, tokens array<string>")
    out = normalise.simple_normalise(df, ["id"], words(spark, "see", "you", "u"), spark.createDataFrame([("tmrw", "tomorrow"), ("u", "x")], "oov string, iv string"))
    assert {r.id: r.norm_tokens for r in out.collect()} == {1: ["see", "you", "tomorrow", "u", "."], 2: []}


def test_votes_and_ranks(spark):
    df = spark.createDataFrame([(1, x) for x in "xyzxyy"] + [(2, x) for x in "xyxyz"], "id long, v string")
    assert {r.id: r.v for r in ranking.most_frequent(df, ["id"], "v").collect()} == {1: "y", 2: None}
    cs = spark.createDataFrame([(1, "plane", c) for c in ("plate", "slate", "plaster", "elephant")], "id long, query string, cand string")
    got = {r.cand: r.r for r in ranking.rank_by(cs, ["id"], F.levenshtein("query", "cand"), "r").collect()}
    assert got == {"plate": 0, "slate": 1, "plaster": 2, "elephant": 3}
    assert ranking.choose_candidate(cs, ["id"]).first().cand == "plate"


def test_context_features(spark):
    toks = "we saw a red old boat .".split()
    flat = spark.createDataFrame([(1, toks)], "id long, tokens array<string>").select("id", F.posexplode("tokens").alias("pos", "tok"))
    p = context.positive_features(flat, ["id"], words(spark, "we", "saw", "old", "boat")).filter("pos = 3")
    assert {(r.gov, r.off) for r in p.collect()} == {("we", -3), ("saw", -2), ("old", 1), ("boat", 2)}
    cs = spark.createDataFrame([("red", "rod"), ("red", "rid")], "query string, cand string")
    assert context.negative_features(p, cs).count() == 8


def test_merge_and_prefix(spark):
    s = "word string, freq long, data array<string>"
    m = lexicon.merge(spark.createDataFrame([("hey", 5, ["a"])], s), spark.createDataFrame([("hey", 61, None), ("go", 40, None), ("gone", 300, None)], s))
    got = {r.word: (r.freq, r.data) for r in m.collect()}
    assert got["hey"] == (66, ["a"])
    assert lexicon.prefix_frequency(m, ["go"]).first().freq == 340


def test_duplicates_and_formats(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "one two threes"), (3, "one two"), (4, "four five six seven")], "id long, text string")
    assert sorted(r.id for r in clean.without_duplicates(df, ["id"]).collect()) == [1, 4]
    again = clean.without_duplicates(clean.without_duplicates(df, ["id"]), ["id"])
    assert again.count() == 2
    j = readers.parse_json(spark.createDataFrame([('{"tokens": ["a", "b"]}',), ('{"text": "Some text"}',)], "value string"))
    assert sorted((r.text, r.tokens) for r in j.collect()) == [("Some text", ["some", "text"]), ("a b", ["a", "b"])]


def test_dependencies(spark, tmp_path):
    from plainword.operators import depbank

    (tmp_path / "nyt1.xml").write_text(
        "<FILE><DOC><sentences><sentence><tokens><token id='1'><word>Hello</word></token><token id='2'><word>zzz</word></token></tokens><basic-dependencies>"
        "<dep type='root'><governor idx='0'>ROOT</governor><dependent idx='1'>Hello</dependent></dep><dep type='x'><governor idx='1'>Hello</governor><dependent idx='2'>zzz</dependent></dep>"
        "<dep type='x'><governor idx='q'>Hello</governor><dependent idx='2'>zzz</dependent></dep></basic-dependencies></sentence></sentences></DOC></FILE>"
    )
    s = depbank.read_sentences(spark, str(tmp_path), "nyt*")
    got = depbank.untyped_dependencies(s, words(spark, "hello"))
    assert [(r.gov, r.off) for r in got.collect()] == [("hello", -1)]
    assert depbank.dependency_frequency(got).first().score == 1.0


def test_models_of_the_queries_take_all_pairs_and_sounds(spark, tmp_path, monkeypatch):
    from plainword.plans import queries
    from plainword.plans.config import Config

    said = ["night falls on beans hills", "knight falls on bears here", "beats fall on night here"] * 40
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(said)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen = {}

    def pairs(tweets, ids, dictionary, phonetic, c):
        seen["phonetic"], seen["config"] = phonetic, c
        return spark.createDataFrame([], "oov string, iv string")

    monkeypatch.setattr(queries.jobs, "normalisation_pairs", pairs)
    monkeypatch.setattr(queries.classifier, "train", lambda features, solver: seen.update(negatives={r.dep for r in features.filter("NOT label").collect()}))
    m = queries._models(spark, str(tmp_path))
    assert seen["config"].nmd_pairs == Config().nmd_pairs == 40000 and seen["config"].lex_dist == 2
    for phonetic in (m.phonetic, seen["phonetic"]):
        assert ["knight", "night"] in [r.words for r in phonetic.collect()]
    assert "hills" in seen["negatives"]  # only "falls" is near, two edits apart


def test_context_counts_equal_plain_loops(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = [[rng.choice("abcdef") for _ in range(rng.choice((0, 1, 3, 12, 40)))] for _ in range(30)]
    df = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)] + [(99, 0, None)], "x long, y long, tokens array<string>")
    for n, width in ((1, 2), (2, 3), (3, 1)):
        expected = Counter()
        for t in texts:
            for p, w in enumerate(t):
                for off in (o for o in range(-width, width + 1) if o):
                    start = p + off if off > 0 else p + off - (n - 1)
                    gram = tuple(t[start : start + n]) if start >= 0 else ()
                    if w in "aef" and len(gram) == n and set(gram) <= set("abc"):
                        expected[w, off, gram] += 1
        rows = context.context_counts(df, ["x", "y"], words(spark, "a", "e", "f", None), words(spark, "a", "b", "c", "c", None), n, width).collect()
        assert {(r.word, r.off, tuple(r.gram)): r.cnt for r in rows} == expected and len(rows) == len(expected)
