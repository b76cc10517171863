from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from plainword.llm import mixing


def best_fit(lengths, budget):
    """Largest sum of documents up to the budget, by trying all sums."""
    sums = {0}
    for n, c in lengths:
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def test_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    exact = 0
    for _ in range(200):
        lengths = [(int(n), int(c)) for n, c in zip(rng.choice(np.arange(1, 90), 5, replace=False), rng.integers(1, 7, 5))]
        budget = int(rng.integers(0, sum(n * c for n, c in lengths) + 9))
        take = mixing.fit_lengths(lengths, budget)
        got = sum(n * k for n, k in take.items())
        assert all(0 <= take[n] <= c for n, c in lengths) and got <= budget
        best = best_fit(lengths, min(budget, sum(n * c for n, c in lengths)))
        exact += got == best
        assert got >= best - 9 and (got == best or budget > mixing.LAST * max(n for n, _ in lengths))
    assert exact > 190


def test_many_long_lengths_fit_within_a_word():
    rng = np.random.default_rng(2)
    for _ in range(10):  # rounding off every length leaves far more than the longest one
        lengths = [(int(n), int(c)) for n, c in zip(rng.choice(np.arange(1, 20000), 4000, replace=False), rng.integers(1, 9, 4000))]
        budget = sum(n * c for n, c in lengths) * int(rng.integers(1, 99)) // 100
        assert budget - 1 <= sum(n * k for n, k in mixing.fit_lengths(lengths, budget).items()) <= budget


def level_targets(sizes):
    """Targets by water filling in whole fractions: sources in order, weights 5, 2, 1."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, out, free = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        free -= over
    return out


def table(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 60))), str(rng.choice(["a", "b", "c", "d"])) if i % 9 else None, 5, "x") for i in range(400)]
    rows += [(7, None, "a", 5, "x"), (None, "one two", "b", 5, "x"), (None, "one two", "b", 5, "x"), (8, "a b c", "a", 1, "y"), (8, "d e f", "a", 2, "z"), (9, "word " * 90, "c", 5, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string")


def test_mix_equals_brute_force(spark):
    rows, df = table(spark)
    got = mixing.mix_sources(df).collect()
    want_size = Counter()
    for _, t, s, *_ in rows:
        want_size[s] += len((t or "").split())
    want, taken = level_targets(want_size), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == want_size[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_sources(df.orderBy("size", "copies").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_rows_are_the_mix(spark):
    rows, df = table(spark)
    mixed = mixing.mixed_rows(df)
    got, words = Counter(map(tuple, mixed.collect())), defaultdict(int)
    assert mixed.columns == df.columns and set(got) <= set(rows)
    number = Counter(rows)
    assert all(k <= 2 * number[r] for r, k in got.items())
    for (_, t, s, *_), k in got.items():
        words[s] += k * len((t or "").split())
    taken = defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        taken[r.source] += r.taken
    assert words == taken
    assert Counter(map(tuple, mixing.mixed_rows(df.orderBy("text").repartition(5)).collect())) == got
    assert mixing.mixed_rows(df.limit(0)).count() == 0 == mixing.mix_sources(df.limit(0)).count()
