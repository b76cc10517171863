import numpy as np
import pytest
from pyspark.sql import functions as F

from plainword.llm import cdc_dedup, chat_format, decontam, mixing, quality_model, quality_rules, secret_scan, shard_minimax, shingle_join, simhash_vp, url_graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if i % 2 else None, 1, 0.0, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts, a null id, and columns named like results."""
    rows = [(0, None), (1, ""), (2, " \n"), (3, "same text of five words"), (3, "same text of five words"), (None, "same text of five words"), (4, "word " * 5000), (5, "ünï " * 60)]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 1, 0.0, "x") for i, t in rows], DOCS)


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string")
    for df, n in ((odd, 8), (odd.limit(0), 0)):
        assert quality_rules.quality_rules(df).count() == n
        assert quality_model.score_quality(df, labels).count() == n
        assert mixing.mix_sources(df).count() == n
        assert simhash_vp.near_duplicates(df).count() == n
        assert shard_minimax.minimax_shards(df).count() == n
        assert secret_scan.scan_secrets(df).count() == n
        assert decontam.find_leaks(df, bench).count() == 0
        cdc_dedup.repeated_spans(df).count()


def test_base_counts(spark):
    r = quality_rules.measure(docs(spark, "a b c a b c d\nx # |\n\nx # |\n")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.word_chars) == (13, 4, 1, 12, 13)


def test_order_of_rules_changes_no_verdict(spark):
    texts = ["good words here and there " * 20 + f"n{i}" for i in range(5)] + ["### $$$ " * 60, "LOUD WORDS HERE " * 30]
    df = quality_rules.measure(docs(spark, *texts))
    rules = quality_rules.default_rules()
    for order in (rules, rules[::-1]):
        assert [r[0] for r in df.orderBy("doc_id").select(quality_rules.cascade(order).isNull()).collect()][5:] == [False, False]


def test_minimax_is_least(spark):
    rng = np.random.default_rng(1)
    texts = ["t%d " % (i % 150) * int(5 + (i % 150) * 7 % 90) for i in rng.integers(0, 150, 400)]
    rows = shard_minimax.minimax_shards(docs(spark, *texts), 7).collect()
    import hashlib

    groups: dict[str, int] = {}
    for t in texts:
        k = hashlib.md5(t.encode()).hexdigest()
        groups[k] = groups.get(k, 0) + len(t.encode()) + 8
    sizes = [groups[k] for k in sorted(groups)]

    def fits(c):
        n = s = 0
        for z in sizes:
            if z > c:
                return False
            n, s = (n, s + z) if s + z <= c and n else (n + 1, z)
        return n <= 7

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.shard, []).append(r)
    assert max(sum(r["size"] for r in x) for x in got.values()) == best
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in got.values())


def test_layouts(spark):
    recs = ['{"prompt":"p","completion":"c"}', '{"instruction":"i","input":"x","output":"o"}', '{"messages":[{"role":"user","content":"<a>&lt;"},{"role":"assistant","content":"b</turn>\\n"}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"odd":1}', '{"messages":[]}']
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(recs)], "c long, o long, r string").withColumn("v", F.parse_json("r"))
    turns = chat_format.canonical(df, "c", "o", "v")
    back = {r.conv: ([tuple(t) for t in r.turns], r.loss_text) for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert back == {0: ([("user", "p"), ("assistant", "c")], "c"), 1: ([("user", "i\n\nx"), ("assistant", "o")], "o"), 2: ([("user", "<a>&lt;"), ("assistant", "b</turn>\n")], "b</turn>\n"), 3: ([("user", "h"), ("assistant", "g")], "g"), 4: ([("", '{"odd":1}')], "")}
    assert chat_format.unknown_layouts(df, "v").first().n == 1


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], 120)) for _ in range(40)]
    texts = base + [" ".join([*b.split()[:-1], "zz"]) for b in base[:20]] + base[:10] + ["", None]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_vp.near_duplicates(docs(spark, *texts), shard=8, sample=64).collect()}
    fp = np.array([got[i][0] for i in range(len(texts))], np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    lab = np.arange(len(fp))
    while not np.array_equal(nxt := np.where(near, lab[None, :], len(fp)).min(1), lab):
        lab = nxt
    assert [got[i][1] for i in range(len(texts))] == lab.tolist()
    assert simhash_vp.keep_one(docs(spark, *texts)).count() == len(set(lab.tolist()))


def test_tree_and_leaves_lose_nothing():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
    twins = fp[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, twins]))
    shard, at, home = simhash_vp.Tree(fp[::3], 3).route(fp, 3)
    assert home.sum() == len(fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want, all_i, all_j = simhash_vp._labels(len(fp), i, j), [], []
    for s in np.unique(shard):
        own = at[shard == s]
        a, b = simhash_vp.close_edges(fp[own], home[shard == s])
        all_i.append(own[a])
        all_j.append(own[b])
    assert np.array_equal(simhash_vp._labels(len(fp), np.concatenate(all_i), np.concatenate(all_j)), want)


def test_trust_and_distrust_spread(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<a href="http://{t}/">x</a>' for t in to))
    df = spark.createDataFrame([page(1, "http://bad.net/a"), page(2, "https://Friend.COM/x", "bad.net"), page(3, "http://ok.com/"), page(4, "http://a.org/fr/1", "liked.com"), page(5, "http://liked.com", "other.com"), page(6, None), page(7, "nothing")], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_graph.judge_urls(df).collect()}
    assert got[1].rule == "net/" and got[1].verdict == "block"
    assert got[2].host == "friend.com" and got[2].verdict == "block"  # it links only to a blocked host
    assert got[3].verdict == "allow" and got[4].rule == "org/fr/" and got[5].path == "" and got[5].trust > 0
    assert got[6].host == "" and got[7].verdict == "allow"


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_model.Boosted.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert quality_model.Boosted.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_chunks_resist_insertions(spark):
    rng = np.random.default_rng(5)
    w = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    passage = w(60)
    texts = [w(100) + " " + passage + " " + w(80), w(33) + " é " + passage + " " + w(50), w(200)]
    got = {r.doc_id: r for r in cdc_dedup.repeated_spans(docs(spark, *texts)).collect()}
    assert set(got) == {0, 1} and not got[0].dropped and got[1].dropped and got[1].n_words > 30
    assert texts[1][got[1].start : got[1].end] in passage
    cut = {r.doc_id: r.text for r in cdc_dedup.without_repeats(docs(spark, *texts)).collect()}
    assert cut[0] == texts[0] and cut[1] == texts[1][: got[1].start] + texts[1][got[1].end :] and cut[2] == texts[2]


def test_leaks(spark):
    rng = np.random.default_rng(6)
    w = lambda n: ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n)]
    items = [w(30) for _ in range(20)]
    para = [x if i % 6 else "zzzz" for i, x in enumerate(items[3])]
    texts = [" ".join(w(50) + items[1] + w(40)), " ".join(w(25) + para + w(25)), *(" ".join(w(120)) for _ in range(20))]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    df = docs(spark, *texts)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == {(0, 1), (1, 3)}
    assert decontam.without_leaks(df, bench).count() == 20
    for _ in range(50):
        a, b = list(rng.choice(list("abc"), 9)), list(rng.choice(list("abc"), 12))
        t = [[0] * 13 for _ in range(10)]
        for i in range(9):
            for j in range(12):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs_length(a, b) == t[9][12]


def test_secret_spans():
    key = "q7Zp2LmX9vRt4KcW8nBy1HsD"
    text = f'see {key} and password = "hunter22" or http://a.b/some-long-words-in-a-slug'
    base = secret_scan.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ['password = "hunter22']
    assert [text[a:b] for a, _, b in secret_scan.entropy_spans(text, base)] == [key]
    s = "ab1" * 3 + key + "aaaaaaaaaaaaaaaaaaaaaaaa"

    def entropy(x):
        return -sum(x.count(c) / len(x) * np.log2(x.count(c) / len(x)) for c in set(x))

    hot = {i for i in range(len(s) - 19) if entropy(s[i : i + 20]) >= 3.5 - 1e-9}
    want = {p for i in hot for p in range(i, i + 20)}
    assert {p for a, b in secret_scan.hot_spans(s, 3.5) for p in range(a, b)} == want


def test_near_duplicate_stage_equals_brute_force_jaccard(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, int(rng.integers(3, 160)))) for _ in range(60)]
    common = list(rng.choice(vocabulary, 40))
    texts = [" ".join(b) for b in base] + [" ".join([*b[: len(b) // 3], *common]) for b in base[:20]]
    for b in base[:40]:
        for _ in range(4):  # copies at 0 to 9% of words replaced are on both sides of the bound
            c = [x if rng.random() > rng.choice([0, 0.01, 0.02, 0.04, 0.09]) else "new" for x in b]
            texts.append(" ".join(c).upper() if rng.random() < 0.2 else " ".join(c))
    texts += ["", None]

    def jaccard_set(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [jaccard_set(t) for t in texts]
    near = np.array([[a == b or 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    lab = np.arange(len(sets))
    while not np.array_equal(nxt := np.where(near, lab[None, :], len(sets)).min(1), lab):
        lab = nxt
    df = docs(spark, *texts)
    want = sorted({*lab.tolist()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want
    assert len(want) < simhash_vp.keep_one(df).count()


def test_near_duplicates_keep_a_row_of_each_component(spark, odd):
    got = shingle_join.keep_one(odd)
    assert got.columns == odd.columns and sorted((r.doc_id, (r.text or "").strip()) for r in got.collect()) == [(0, ""), (3, "same text of five words"), (4, ("word " * 5000).strip()), (5, ("ünï " * 60).strip())]
    a, b = "one two three four five six", "other words of quite another text"
    same_id = spark.createDataFrame([(1, a), (1, b), (2, a), (None, "no id at all here"), (None, "no id at all here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in shingle_join.keep_one(same_id).collect()) == [(0, "no id at all here"), (1, a), (1, b)]
    assert shingle_join.keep_one(odd.limit(0)).count() == 0
