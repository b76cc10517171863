"""Mixing sources to target weights by subset-sum fitting.

Sources share a budget of words by weight; no target exceeds ``max_copies`` times its source's size, and what
exceeds it is shared anew by weight (``targets``: the common level at which all targets meet the budget). Each document is taken
floor(target / size of source) times; for the rest, documents of a source are counted by exact length, a proportional count of each
length is taken, and bounded-knapsack dynamic programming over the lengths left fits the remaining budget (``fit_lengths``).
Which documents of a length are taken follows from a seeded hash of their id, then the id, then a digest of their text: rows alike in all of these
are alike in the result too, so reruns agree.

Null and empty texts have size 0 and are taken once, with 0 words. Null sources are one source, last in order. Repeated
rows and rows with the same id count as documents of their own. An empty table gives an empty result. Sources are taken to be few: one row of each
is ordered in one task. Only the id, text and source columns are read, and rows of ``mixed_rows`` travel as one struct, so other names can't clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Dynamic programming fits the last so many times the longest length.
LAST = 4


def fit_lengths(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Documents of each length to take so that their words come as near to ``budget`` from below as the program finds.

    lengths: (length, documents of it), lengths over 0. Three steps: the same share of every length, but for ``LAST`` times the longest; single documents, those that the share
    rounded off most first, while more than ``LAST`` + 1 times the longest is left; bounded knapsack (0/1 items of 1, 2, 4, ... documents) over
    all reachable sums of the rest, as bits of one integer, which ends early on an exact fit. The program's size follows the longest length,
    not the documents."""
    total = sum(n * c for n, c in lengths)
    budget = max(0, min(budget, total))
    if not total:
        return {}
    longest = max(n for n, _ in lengths)
    spread = max(0, budget - LAST * longest)
    take = {n: c * spread // total for n, c in lengths}
    left = budget - sum(n * k for n, k in take.items())
    for n, c in sorted(lengths, key=lambda x: (-(x[1] * spread % total), -x[0])):
        if left < (LAST + 1) * longest:
            break
        if take[n] < c:
            take[n] += 1
            left -= n
    if left:
        mask, reach, steps = (1 << (left + 1)) - 1, 1, []
        for n, c in sorted(lengths, reverse=True):
            free, part = min(c - take[n], left // n), 1
            while free > 0 and not reach >> left & 1:
                part = min(part, free)
                steps.append((n, part, reach))
                reach |= reach << n * part & mask
                free -= part
                part *= 2
        at = reach.bit_length() - 1
        for n, part, before in reversed(steps):
            if not before >> at & 1:
                take[n] += part
                at -= n * part
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """skey, source, source_size, target. sizes: skey, source, source_size; one row per source.

    With cap = max_copies * size, the targets are min(cap, level * weight), where the level makes their sum the budget. In the order of
    cap / weight, the level is the first at which no later source meets its cap."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(rank, F.lit(len(weights))).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size").cast("double") * max_copies).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    before = Window.orderBy("__ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    budget = F.sum("source_size").over(every) * F.lit(share)
    s = s.withColumn("__level", (budget - past("__cap")) / (F.sum("__w").over(every) - past("__w")))
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "skey", "__level"))).over(every)
    s = s.withColumn("__level", first["__level"])
    return s.select("skey", "source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, salts: int, *more: Column) -> DataFrame:
    """doc_id, source, skey, size, h, digest, salt, and ``more``."""
    doc = F.col(id_col).alias("doc_id")
    return df.select(
        doc, F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.xxhash64(F.col(text_col)).alias("digest"), *more,
    ).withColumn("salt", F.pmod(F.xxhash64("h", "digest"), F.lit(salts)).cast("int"))


def _placed(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """``rows`` with source_size, target and copies. rows and sized: as ``_sized`` gives them, of the same documents.

    Each (source, size, salt) is ranked by itself, and its offset, and what is taken of its size, come from counts: rows are dealt out once."""
    counts = saved(sized.groupBy("skey", "source", "size", "salt").agg(F.count(F.lit(1)).alias("docs")), "mix-counts")
    by_size = counts.groupBy("skey", "source", "size").agg(F.sum("docs").alias("docs"))
    goal = targets(by_size.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, share, max_copies)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        target, whole = float(pdf.target.iloc[0]), int(pdf.source_size.iloc[0])
        base = min(max_copies, int(target // whole)) if whole else 0
        take = fit_lengths([(int(n), int(c)) for n, c in zip(pdf["size"], pdf.docs) if n > 0], round(target - base * whole) if base < max_copies else 0)
        return pd.DataFrame({"skey": pdf.skey, "size": pdf["size"], "source_size": whole, "target": target, "base": base, "extra": [take.get(int(n), 0) for n in pdf["size"]]})

    plan = by_size.select("skey", "size", "docs").join(goal.select("skey", "source_size", "target"), "skey").groupBy("skey").applyInPandas(fit, "skey string, size long, source_size long, target double, base long, extra long")
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("skey", "size", "salt", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("offset"))
    offsets = saved(offsets.join(plan, ["skey", "size"]), "mix-plan")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy("h", "doc_id", "digest")) - 1)
    met = ranked.join(offsets, ["skey", "size", "salt"])
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + (F.col("offset") + F.col("rank") < F.col("extra")).cast("long"))
    return met.withColumn("copies", copies.cast("long"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 11, salts: int = 256) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken."""
    sized = saved(_sized(df, id_col, text_col, source_col, seed, salts), "mix-sizes")
    placed = _placed(sized, sized, weights, share, max_copies)
    return placed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 11, salts: int = 256) -> DataFrame:
    """``df``'s rows, each as often as ``mix_sources`` takes it; columns as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows, sized = (_sized(df, id_col, text_col, source_col, seed, salts, *more) for more in ([row], []))
    placed = _placed(rows, sized, weights, share, max_copies).filter("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
