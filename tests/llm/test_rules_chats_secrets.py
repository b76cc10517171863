import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainword.llm import chat_format, quality_rules, secret_scan, url_graph


def test_rules_stand_by_rejections_a_second_of_rows_left():
    rule = lambda name: quality_rules.Rule(name, None)
    est = lambda name, rows, seconds: quality_rules.Estimate(rule(name), frozenset(rows), seconds)
    some = [est("dear", range(60), 6.0), est("cheap", range(40), 1.0), est("same_as_cheap", range(39), 1.1), est("other", range(40, 50), 1.0), est("none_dear", (), 2.0), est("none", (), 1.0)]
    assert [r.name for r in quality_rules.ordered(some)] == ["cheap", "other", "dear", "none", "none_dear", "same_as_cheap"] or [r.name for r in quality_rules.ordered(some)][:3] == ["cheap", "other", "dear"]


def test_estimates_count_rows_that_pass_the_base_rule(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(60)]
    texts = good + [t + " #" * 20 for t in good[:30]] + ["a b # # #"] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [quality_rules.Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")), quality_rules.Rule("never", F.col("n_words") < 0)]
    got = {e.rule.name: len(e.rejected) for e in quality_rules.estimate(df, rules)}
    assert got == {"symbols": 30, "never": 0}
    kept = {r.doc_id for r in quality_rules.quality_rules(df, rules=rules).collect() if r.kept}
    assert kept == set(range(60))
    assert quality_rules.estimate(df.limit(0), rules)[0].rejected == frozenset()


@pytest.mark.parametrize("record,want", [
    ('{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a","name":"m"}]}', [("messages", "user", "q"), ("messages", "assistant", "a")]),
    ('{"id":7,"prompt":"p","completion":"c"}', [("prompt", "user", "p"), ("prompt", "assistant", "c")]),
    ('{"id":7,"instruction":"i","input":"x","output":"o"}', [("instruction_input", "user", "i\n\nx"), ("instruction_input", "assistant", "o")]),
    ('{"role":null,"content":"c"}', [("message", "", "c")]),
    ('{"text":"t"}', [(None, "", '{"text":"t"}')]),
    ('{"messages":[]}', []),
])
def test_layouts_with_other_fields(spark, record, want):
    df = spark.createDataFrame([(1, 0, record), (1, 0, None)], "c long, o long, r string").withColumn("v", F.parse_json("r"))
    got = [(r.layout, r.role, r.text) for r in chat_format.canonical(df, "c", "o", "v").orderBy("seq").collect()]
    assert got == want


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "<turn>&lt;&amp;"), (1, 1, "assistant", "</turn>\n<text>"), (1, 1, "assistant", "</turn>\n<text>"), (1, 2, None, None), (2, None, "assistant", ""), (None, 0, "assistant", "x" * 300000), (None, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv long, ord long, role string, text string").withColumn("seq", F.lit(0)).fillna("", ["role", "text"])
    got = {r.conv: ([tuple(t) for t in r.turns], r.loss_text) for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    bad = "</turn>\n<text>"
    assert got == {1: ([("user", "<turn>&lt;&amp;"), ("assistant", bad), ("assistant", bad), ("", "")], bad * 2), 2: ([("assistant", "")], ""), None: ([("assistant", "x" * 300000), ("user", "y")], "x" * 300000)}
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_base_secrets_equal_plain_matching(spark):
    rng = np.random.default_rng(3)
    bits = ["password", "Passwd", "SECRET", "api_key", "apikey", "token", ":", "=", " = ", '"', "'", " ", "AKIA", "ABCDEFGHIJ12345678", "deadbeef" * 3, "0123456789abcdef", "hunter22", "é", "\n", "ab", "x.y/z"]
    texts = ["".join(rng.choice(bits, 40)) for _ in range(80)] + [None, "", "é" + "deadbeef" * 4]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = []
        for kind, pattern, group, least in (
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        ):
            spans += [(m.start(), "assign access hex".split().index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "", re.A) if len(m[group]) >= least]
        listed = [s for *_, s in sorted(spans)]
        assert found[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in listed) for k in ("assign", "access", "hex")]
        assert set(listed) <= set(found[i].spans.split(",")) | {""}


@pytest.mark.parametrize("text,want", [
    ("-" * 12 + "q7Zp2LmX9vRt4KcW8nBy1HsD", "q7Zp2LmX9vRt4KcW8nBy1HsD"),
    ("/example/q7Zp2LmX9vRt4KcW8nBy1HsD", "q7Zp2LmX9vRt4KcW8nBy1HsD"),
    ("Key-9F3A7C21D0B84E6F5A19", "9F3A7C21D0B84E6F5A19"),
    ("q7Zp2LmX9vRt4KcW8nBy1HsD" + "a" * 20, "q7Zp2LmX9vRt4KcW8nBy1HsD"),
    ("id 3f2504e0-4f89-11d3-9a0c-0305e82c3301", None),
    ("a/long-path/of-words_and/example-names", None),
    ("12345678901234567890123", None),
])
def test_allow_list_takes_spans_only(text, want):
    assert [text[a:b] for a, _, b in secret_scan.entropy_spans(text, [])] == ([want] if want else [])


def test_trust_goes_down_long_chains(spark):
    page = lambda i, url, to=None: (i, url, f'<a href="http://{to}/">x</a>' if to else None)
    rows = [page(0, "http://s.org/fr/", "h1.com")] + [page(i, f"http://h{i}.com/", f"h{i + 1}.com") for i in range(1, 15)] + [page(90, None), page(90, "x")]
    got = {r.host: r for r in url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 15):  # one link each: 0.85 of the score before
        assert abs(got[f"h{k}.com"].trust - 0.15 * 0.85**k) < 1e-9
    assert got[""].verdict == "allow" and url_graph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_scores_equal_power_iteration(spark):
    rng = np.random.default_rng(5)
    n = 12
    a = (rng.random((n, n)) < 0.25) & ~np.eye(n, dtype=bool)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", 1) for i, j in zip(*np.nonzero(a))], "src string, dst string, n long")
    seed = rng.random(n)
    seeds = spark.createDataFrame([(f"h{i}", float(s)) for i, s in enumerate(seed)], "host string, seed double")
    pass_on, want = a / np.maximum(a.sum(1), 1)[:, None], np.zeros(n)
    for _ in range(400):
        want = 0.15 * seed + 0.85 * want @ pass_on
    got = {r.host: r.score for r in url_graph.spread(seeds, edges, 0.85, 1e-3).collect()}
    assert all(abs(got.get(f"h{i}", 0) - want[i]) < 1e-3 * seed.sum() for i in range(n))
