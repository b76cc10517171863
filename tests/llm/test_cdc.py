import numpy as np

from plainword.llm import cdc_dedup


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, start string, uid int")


def test_rows_that_share_an_id_are_not_cut_by_each_other(spark):
    rng = np.random.default_rng(1)
    one, other = words(rng, 120), words(rng, 120)
    df = table(spark, [(1, one), (2, one), (2, other), (None, other + " end"), (None, one), (2, one)])
    got = sorted((r.doc_id or 9, r.text) for r in cdc_dedup.without_repeats(df).collect())
    assert (1, one) in got and (2, other) in got  # first occurrences stay whole
    assert len(got) == 6 and sorted(len(t) < 40 for _, t in got) == [False, False, True, True, True, True]


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for k in range(60):
        n = int(rng.choice([12, 25, 70, 90]))
        passage = words(rng, n)
        for z in range(2):
            rows.append((2 * k + z, f"{words(rng, int(rng.integers(20, 90)))} {passage} {words(rng, int(rng.integers(20, 90)))}"))
            if n > 50:
                want.add(2 * k + z)
    runs = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 50):
            runs.setdefault(tuple(w[j : j + 51]), set()).add(i)
    assert want == {i for found in runs.values() if len(found) > 1 for i in found}
    got = {r.doc_id: r for r in cdc_dedup.repeated_spans(table(spark, rows)).collect()}
    assert set(got) == want
    for i, r in got.items():  # each span stands in another document too
        part = rows[i][1][r.start : r.end]
        assert any(part in t for j, t in rows if j != i) and r.dropped == (i % 2 == 1)


def test_odd_rows(spark):
    long = "word " * 600000
    df = table(spark, [(1, None), (2, ""), (3, long), (4, long), (None, None), (5, "ünï çødé " * 90), (6, "ünï çødé " * 90)])
    got = {r.doc_id: r.text for r in cdc_dedup.without_repeats(df).collect()}
    assert got[1] is None and got[2] == "" and len(got[4]) < 600 and cdc_dedup.without_repeats(df).columns == df.columns
    assert cdc_dedup.repeated_spans(df.limit(0)).count() == 0 == cdc_dedup.without_repeats(df.limit(0)).count()
