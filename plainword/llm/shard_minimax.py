"""Sharding by a minimax contiguous partition of atomic groups (rows with equal texts), in native operations.

Groups stand in the order of their text's MD5. The smallest shard capacity for which greedy filling needs at
most ``shards`` shards is found by binary search; cuts are made under it, and evened where it leaves a choice. The driver never holds all groups: it holds sums of ranges of
MD5 prefixes (65,536 at first), under which greedy filling is bounded from both sides; only ranges in which a
cut may fall are split further, a hex digit at a time, until each cut is known to the group. Between the two
bounds at most about 3 * shards**2 ranges can hold a cut, so what the driver gathers does not grow with the input.

Null text counts as empty (size 8, CRC 0). Repeated rows and repeated ids are rows of their own with slots of
their own. A group larger than the mean shard can't be split, and sets the capacity; later shards may then stay
empty. An empty table gives an empty result. Only the id and text columns are read, so other names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_rank, saved


class Ranges:
    """Consecutive ranges of group keys: prefix, bytes, and whether it is a single group."""

    def __init__(self, rows: list[tuple[str, int, bool]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.rows else 0

    def fill(self, capacity: int, shards: int, generous: bool) -> tuple[list[int], list[int], bool]:
        """Greedy cuts: positions, the range at each cut, and whether all fits. In a range of several groups the cut
        falls where the capacity ends if ``generous``, else before the range: bounds of the true cut from both sides."""
        at, cuts, inside = 0, [], []
        for _ in range(shards):
            if at + capacity >= self.total:
                return cuts, inside, True
            i = bisect_right(self.ends, at + capacity)
            start = self.ends[i - 1] if i else 0
            at = max(at, at + capacity if generous and not self.rows[i][2] else start)
            cuts.append(at)
            inside.append(i)
        return cuts, inside, False

    def least(self, low: int, shards: int, generous: bool) -> int:
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, generous)[2]:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, low: int, high: int, shards: int) -> set[str]:
        """Prefixes of the ranges of several groups in which a cut may fall for a capacity from ``low`` to ``high``."""
        near, far = [0, *self.fill(low, shards, False)[0]], [0, *self.fill(high, shards, True)[0]]
        out: set[str] = set()
        for k in range(shards):
            a, b = near[min(k, len(near) - 1)] + low, far[min(k, len(far) - 1)] + high
            for i in range(bisect_right(self.ends, a), min(bisect_right(self.ends, b) + 1, len(self.rows))):
                if not self.rows[i][2]:
                    out.add(self.rows[i][0])
        return out


    def evened(self, capacity: int, shards: int) -> tuple[list[int], set[str]]:
        """Cuts under the capacity, each as near as may be to an equal share of what is left; and the ranges of several groups they depend on.

        A cut may not come before ``first``, from where greedy filling from the end needs all later shards."""
        doubt: set[str] = set()

        def bounds(at: int) -> tuple[int, int]:
            i = bisect_right(self.ends, at)
            start = self.ends[i - 1] if i else 0
            if i == len(self.rows) or start == at:
                return start, start
            if not self.rows[i][2]:
                doubt.add(self.rows[i][0])
            return start, self.ends[i]

        first, at = [0] * shards, self.total
        for k in range(shards - 1, 0, -1):
            at = bounds(max(0, at - capacity))[1]
            first[k] = at
        cuts, at = [], 0
        for k in range(1, shards):
            want = at + (self.total - at) // (shards - k + 1)
            low, high = bounds(want)
            cut = low if want - low <= high - want else high
            at = max(at, first[k], min(cut, bounds(at + capacity)[0]))
            cuts.append(at)
        return cuts, doubt


def minimax_cuts(groups: DataFrame, shards: int, digits: int = 4) -> tuple[int, list[str]]:
    """Smallest capacity, and the key prefixes at which shards 1, 2, ... begin. groups: (g string, bytes long)."""

    def ranges(of: DataFrame, n: int) -> list[tuple[str, int, bool]]:
        rows = of.groupBy(F.substring("g", 1, n).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return [(r.p, r.b, r.n == 1) for r in rows]

    largest = groups.agg(F.max("bytes")).first()[0] or 0
    found = Ranges(ranges(groups, digits))
    while True:
        least = max(largest, -(-found.total // shards))
        low, high = found.least(least, shards, True), found.least(least, shards, False)
        doubt = found.doubtful(low, high, shards)
        if not doubt:
            cuts, doubt = found.evened(low, shards)
            if not doubt:
                at = [bisect_left(found.ends, c + 1) for c in cuts]
                return low, [found.rows[i][0] if i < len(found.rows) else "~" for i in at]
        rows = [r for r in found.rows if r[0] not in doubt]
        for n in sorted({len(p) for p in doubt}):
            some = [p for p in doubt if len(p) == n]
            rows += ranges(groups.filter(F.substring("g", 1, n).isin(some)), n + 1)
        found = Ranges(rows)


def shard_of(key: Column, cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (key >= F.lit(c)).cast("int")
    return out


def minimax_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", salts: int = 512) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0), grown_shard (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = saved(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("g"),
        ),
        "shard-sizes",
    )
    groups = saved(narrow.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    placed = narrow.withColumn("shard", shard_of(F.col("g"), cuts))
    ranked = salted_rank(placed, ["shard"], F.pmod(F.xxhash64("doc_id", "g"), F.lit(salts)).cast("int"), [F.col("doc_id"), F.col("g")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
