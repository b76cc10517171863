"""Quality rules as a short-circuit cascade, all in native expressions.

``measure`` computes document counts, ``estimate`` times each rule and finds its rejections on a bounded
sample, ``ordered`` puts first what rejects most per second of the rows left, and ``cascade`` evaluates them as one CASE in
that order: a row stops at its first rejecting rule. The order never changes who is kept, only the cost.

Null text counts as empty. Empty texts have zero counts and fail the base rule. Rows are judged one by one, so ties, repeats,
empty tables and null ids pass through as they are. Only the id and text columns are read: names of other
columns can't clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_of, words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    """rejected: which rows of the sample the rule rejects; seconds: what it takes for all of them."""

    rule: Rule
    rejected: frozenset[int]
    seconds: float


#: Rows whose rules are timed, about; how often each stands in the timed table; runs, of which the median counts.
SAMPLE_ROWS, COPIES, RUNS = 1000, 4, 3


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``__t`` (text), ``__w`` (words) and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    w = t.withColumn("__w", words(F.col("__t"))).withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("__w")

    def window(i: Column) -> Column:
        at = [F.get("__w", i + k) for k in range(3)]
        return F.struct(F.xxhash64(*at).alias("h"), i.alias("p"))

    # Windows sorted by content: one found twice stands beside its equal.
    s = w.withColumn("__s", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))))
    def same(x: Column, i: Column) -> Column:
        """Hashes sort the windows; where two beside each other are equal, the words decide."""
        y, word = F.get("__s", i), lambda p, k: F.get("__w", p + k)
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (word(x["p"], k) == word(y["p"], k))
        return F.coalesce(equal, F.lit(False))

    twice = F.transform("__s", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
    p = s.withColumn("__p", F.sort_array(F.array_compact(twice))).drop("__s")
    covered = F.transform("__p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), i + 1) - x, F.lit(3))))
    return p.select(
        "doc_id", "__t", "__w",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        count_of(F.col("__t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Reject expressions over the columns of ``measure``. All compare whole numbers, so no rounding decides."""
    t, n = F.col("__t"), F.col("n_words")
    letters, capitals, digits = count_of(t, r"\p{L}"), count_of(t, r"\p{Lu}"), count_of(t, "0-9")
    alpha = F.size(F.filter("__w", lambda x: x.rlike(r"\p{L}"))).cast("long")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)),
        Rule("capitals", 10 * capitals > 3 * letters),
        Rule("digits", 10 * digits > 2 * F.col("word_chars")),
        Rule("wordless", 10 * alpha < 8 * n),
        Rule("repeated_lines", (F.col("n_dup_lines") > 1) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("few_distinct_words", 10 * F.size(F.array_distinct("__w")) < n),
    ]


def estimate(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Each rule's rejections and seconds on a seeded sample of about ``sample_rows`` rows, of which those count that pass the base rule, as in the cascade.

    Rows are sampled before they are measured, so this pass costs a scan; the measured sample is kept in memory meanwhile. Each rule runs once
    unmeasured, for its code to be compiled, then ``RUNS`` times over ``COPIES`` of the sample; the median counts, less that of a pass without a rule."""
    narrow = df.select(id_col, text_col)
    drawn = narrow.sample(fraction=min(1.0, sample_rows / max(narrow.count(), 1)), seed=seed).limit(2 * sample_rows)
    sample = measure(drawn, id_col, text_col).persist()
    try:
        passed = sample.filter(~base_failed())
        hits = passed.select(*(F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules))).collect() if rules else []
        many = passed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

        def seconds(rejects: Column) -> float:
            counted, took = many.agg(F.sum(rejects.cast("int"))), []
            for _ in range(RUNS + 1):
                began = time.perf_counter()
                counted.collect()
                took.append(time.perf_counter() - began)
            return median(took[1:])

        idle = seconds(F.col("n_words") < 0)
        return [Estimate(r, frozenset(k for k, row in enumerate(hits) if row[i]), max(seconds(r.rejects) - idle, 1e-4)) for i, r in enumerate(rules)]
    finally:
        sample.unpersist()


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Next comes always the rule with the most rejections a second among the rows that no earlier rule rejects; among rules without any, the cheapest."""
    left, gone, out = list(estimates), set(), []
    while left:
        best = min(left, key=lambda e: (-len(e.rejected - gone) / e.seconds, e.seconds, e.rule.name))
        left.remove(best)
        gone |= best.rejected
        out.append(best.rule)
    return out


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, else null. Later branches aren't evaluated for that row."""
    if not rules:
        return F.lit(None).cast("string")
    case = F
    for r in rules:
        case = case.when(r.rejects, F.lit(r.name))
    return case


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rules = default_rules() if rules is None else rules
    best = ordered(estimate(df, rules, id_col, text_col, sample_rows))
    return measure(df, id_col, text_col).withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(best).isNull()).alias("kept"),
    )
