"""SimHash near-duplicates, linked exactly with vantage-point trees over distinct fingerprints.

1. ``fingerprints``: 64 bits per text from the XXH64 values of its shingles.
2. Distinct fingerprints are the nodes. The upper levels of a vantage-point tree, built on a bounded sample, split them into shards by Hamming distance to
   vantage points. Each fingerprint has one home shard and is sent as a query to the later shards that the triangle inequality can't rule out
   (distance to the vantage point within ``bits`` of the radius), so each close pair meets in exactly one shard.
3. Within a shard the tree goes on in memory down to small leaves, which are compared exactly. A leaf yields edges that span its close pairs, not all pairs.
4. Components of these edges; the smallest id in a component names it.

No link is lost: every bound is exact, and the sample only shapes the tree. For evenly spread fingerprints, the work grows as
the power 1.7 of their number, since a radius of 3 around a median distance of 32 cuts off about 0.38 of a query's branches.

Null text counts as empty; texts without words have fingerprint zero and link like any others. Rows with equal ids are rows of their own, with the same
component if their texts link. Null ids take part, but name a component only if it has no other id (then it is null). An empty table gives an empty result.
Only the id and text columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved
from .components import components

BITS = 3
#: Fingerprints a shard is meant to hold, rows of the sample for the upper tree, and fingerprints in a leaf.
SHARD, SAMPLE, LEAF = 8192, 16384, 48


def simhash(h: np.ndarray) -> int:
    """64 bits (as a signed number): each is 1 if it is set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """bytes.lower and bytes.split know ASCII only, which is what the definition asks for."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < width else [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))]
    one = xxhash.xxh64_intdigest
    return simhash(np.fromiter((one(p, 42) for p in parts), np.uint64, len(parts)))


def with_fingerprint(df: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """row (all columns of ``df``), fp (long; the 64 bits of its text)."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], names=["row", "fp"])

    return whole.mapInArrow(run, StructType([whole.schema["row"], StructField("fp", LongType())]))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


class Tree:
    """Upper levels of the tree: node i has children 2i+1 (distance to its vantage point at most its radius) and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.points = rng.integers(0, 1 << 63, 2**depth - 1, np.uint64) << np.uint64(1)
        self.radii = np.full(2**depth - 1, 31, np.int64)
        self._grow(sample, 0, rng)

    def _grow(self, part: np.ndarray, node: int, rng) -> None:
        if node >= len(self.points):
            return
        d = None
        if len(part) >= 16:  # else a random point with the middle distance of evenly spread fingerprints
            self.points[node] = part[rng.integers(len(part))]
            d = np.bitwise_count(part ^ self.points[node])
            self.radii[node] = int(np.median(d))
        near = d <= self.radii[node] if d is not None else np.zeros(len(part), bool)
        self._grow(part[near], 2 * node + 1, rng)
        self._grow(part[~near] if d is not None else part, 2 * node + 2, rng)

    def route(self, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, place in ``fp``, home) for each home, and for each query to a shard after the home."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = len(self.points)

        def go(node: int, at: np.ndarray, home: np.ndarray, past: np.ndarray) -> None:
            # past: the home lies in an earlier branch; queries to shards before the home are the other side's task.
            if not len(at):
                return
            if node >= first:
                out.append((np.full(len(at), node - first, np.int32), at, home))
                return
            d = np.bitwise_count(fp[at] ^ self.points[node]).astype(np.int64)
            r = self.radii[node]
            near = d <= r
            s = (home & near) | (past & (d <= r + bits))
            go(2 * node + 1, at[s], home[s], past[s])
            later = past | (home & near)
            s = (home & ~near) | (later & (d > r - bits))
            go(2 * node + 2, at[s], (home & ~near)[s], later[s])

        go(0, np.arange(len(fp)), np.ones(len(fp), bool), np.zeros(len(fp), bool))
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable node of each of n nodes."""
    lab = np.arange(n)
    while True:
        a, b = lab[i], lab[j]
        m = a != b
        if not m.any():
            return lab
        np.minimum.at(lab, np.maximum(a[m], b[m]), np.minimum(a[m], b[m]))
        while not np.array_equal(up := lab[lab], lab):
            lab = up
        i, j = i[m], j[m]


def close_edges(fp: np.ndarray, home: np.ndarray, bits: int = BITS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) whose edges connect what pairs of a home and any other within ``bits`` connect."""
    rng, total = np.random.default_rng(seed), len(fp)
    kept_i: list[np.ndarray] = []
    kept_j: list[np.ndarray] = []
    held = 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        kept_i.append(i)
        kept_j.append(j)
        held += len(i)
        if held > 4_000_000:  # contract to a star for each component
            lab = _labels(total, np.concatenate(kept_i), np.concatenate(kept_j))
            own = np.flatnonzero(lab != np.arange(total))
            kept_i[:], kept_j[:], held = [own], [lab[own]], len(own)

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(h), LEAF):
            part = h[a : a + LEAF]
            for b in range(0, len(q), 1 << 15):
                some = q[b : b + (1 << 15)]
                near = np.bitwise_count(fp[part][:, None] ^ fp[some][None, :]) <= bits
                near &= part[:, None] != some[None, :]
                hit = near.any(0)
                if hit.any():
                    m = near[:, hit]
                    keep(some[hit], part[m.argmax(0)])
                    x, y = np.nonzero((m.astype(np.float32) @ m.T.astype(np.float32)) > 0)
                    keep(part[x], part[y])

    stack = [(np.flatnonzero(home), np.arange(total))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) <= LEAF:
            compare(h, q)
            continue
        v = fp[h[rng.integers(len(h))]]
        d, e = np.bitwise_count(fp[h] ^ v).astype(np.int64), np.bitwise_count(fp[q] ^ v).astype(np.int64)
        r = int(np.median(d))
        near = d <= r
        if near.all():
            r -= 1
            near = d <= r
        if not near.any() or near.all():
            compare(h, q)
            continue
        stack.append((h[near], q[e <= r + bits]))
        stack.append((h[~near], q[e > r - bits]))
    if not kept_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lab = _labels(total, np.concatenate(kept_i), np.concatenate(kept_j))
    own = np.flatnonzero(lab != np.arange(total))
    return own, lab[own]


def close_links(fps: DataFrame, bits: int = BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(u, v) edges that connect what pairs within ``bits`` connect. fps: distinct fp (long)."""
    spark, n = fps.sparkSession, fps.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    some = fps.sample(fraction=min(1.0, sample / max(n, 1)), seed=3).limit(2 * sample).toPandas().fp.to_numpy(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(Tree(np.sort(some), depth))  # 16 bytes for each shard of ``shard`` fingerprints

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            s, at, home = tree.route(fp.view(np.uint64), bits)
            for k in range(0, len(s), 1 << 18):
                cut = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(s[cut]), pa.array(fp[at[cut]]), pa.array(home[cut])], names=["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        i, j = close_edges(fp.view(np.uint64), table.column("home").to_numpy(), bits)
        return pa.table({"u": pa.array(fp[i], pa.int64()), "v": pa.array(fp[j], pa.int64())})

    routed = fps.mapInArrow(route, "shard int, fp long, home boolean")
    if depth:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2**depth)
        routed = routed.repartition(parts, "shard")
    return routed.groupBy("shard").applyInArrow(link, "u long, v long")


def _rooted(prints: DataFrame, bits: int, **tree) -> DataFrame:
    """fp, least (smallest id), root (least fingerprint reachable). prints: doc_id, fp."""
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = components(close_links(nodes.select("fp"), bits, **tree))
    return nodes.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS, **tree) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id."""
    prints = saved(fingerprints(df, id_col, text_col, width), "simhash")
    rooted = _rooted(prints, bits, **tree)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS, **tree) -> DataFrame:
    """``df`` with one row of each component: the one with the smallest id (a null id comes last) and, among texts with that id, the least digest.
    Of several rows with that id and text, one stays. A row is told by its id and text, so rows that share only an id don't stand for each other."""
    whole = with_fingerprint(df, text_col, width)
    own = whole.withColumn("id", whole["row"][id_col]).withColumn("md5", F.md5(F.coalesce(whole["row"][text_col], F.lit("")).cast("binary")))
    found = saved(own, "simhash-rows")
    rooted = _rooted(found.select(F.col("id").alias("doc_id"), "fp"), bits, **tree).select("fp", "root")
    each = saved(found.groupBy("fp", "id", "md5").agg(F.count(F.lit(1)).alias("n")).join(rooted, "fp").select("fp", "root", F.struct(F.col("id").isNull().alias("none"), "id", "md5").alias("key")), "simhash-keys")
    heads = each.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.id").alias("hid"), F.col("key.md5").alias("hmd5"))
    kept = found.join(heads, found.id.eqNullSafe(F.col("hid")) & (found.md5 == F.col("hmd5")), "left_semi")
    return kept.dropDuplicates(["id", "md5"]).select("row.*")
