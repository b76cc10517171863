"""SimHash near-dedup for a stated similarity: all pairs that share at least four fifths of their distinct five-word shingles, exactly.

64-bit fingerprints of such pairs differ in about 10 bits, up to 19, and at that radius a vantage-point tree rules out next to nothing. So the tree of ``simhash_vp``
finds the close pairs (``BITS``), which joins most copies, and what it can't reach is found by an exact prefix filter:

1. ``prints``: a text's set is its distinct shingles (XXH64; a shorter text is one shingle). Texts with equal sets are one node, named by the XXH64 of the set.
2. Two sets of similarity 4/5 have a shingle in common among the first n - ceil(4n/5) + 1 of each, in any order of shingles that is the same for all
   (prefix filter; Chaudhuri et al., 2006). The order is by frequency in a sample, rare ones first, so few sets meet; the sample only shapes the order.
3. Pairs from the tree, and each set with one other of each of its prefix shingles, are compared; links join into components. Where a prefix
   shingle still belongs to several components, its sets are compared with ``STARS`` others. After that all pairs with a common prefix shingle that
   are not in one component yet are compared, unless the places of the shingle, the sizes, or a parity bitmap of the sets rule them out. So
   a group of copies costs a few pairs for each member; only sets that share rare shingles, and are not linked by any other, meet pair by pair.
4. Components of the links; the smallest id in a component names it.

No link is lost: every bound is exact, in whole numbers.
Null and empty texts have the same, empty set. Rows with equal ids are rows of their own. Null ids take part, but name a component only if it has no other id.
Rows travel as one struct, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import dropped
from .common import saved, tidy
from .components import components
from .simhash_vp import BITS, close_links, simhash

WIDTH = 5
#: Least similarity as a fraction.
SHARE, OF = 4, 5
#: Documents of the sample at least, its least share of all, and shingles whose frequency is kept.
SAMPLE, PART, HOT = 4096, 1 / 16, 1 << 17
#: Longs of a set's parity, nodes whose list may be broadcast, and sets that each is compared with where components share a shingle.
LONGS, FEW, STARS = 16, 1 << 18, 6


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles, sorted. Case and white space as in ``simhash_vp.fingerprint``."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(w)] if len(w) < width else [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))]
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((one(p, 42) for p in parts), np.uint64, len(parts)))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def prefix(s: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a set has to share one of, rare ones first. hot: sorted shingles with ``counts``; others count as 0."""
    if not len(s):
        return s
    freq = np.zeros(len(s), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        freq = np.where(hot[at] == s, counts[at], 0)
    return s[np.lexsort((s, freq))[: len(s) - -(-SHARE * len(s) // OF) + 1]]


def parity(s: np.ndarray) -> np.ndarray:
    """Whether each of 64 ``LONGS`` buckets has an odd number of shingles: two sets differ in at least as many shingles as these differ in bits."""
    odd = np.bincount((s % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HOT`` of the most frequent shingles of a sample, sorted, and their frequencies. texts: one text column."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                some = [shingles(t.as_py()) for t in whole.column(0).slice(low, 1000)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], names=["key"])

    sample = texts.sample(fraction=min(1.0, max(PART, SAMPLE / max(n, 1))), seed=3)
    counts = saved(sample.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shingle-counts")
    least, held = None, 0
    for c, k in sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True):
        held += k
        if held > HOT:
            break
        least = c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.filter(F.col("n") >= least).toPandas()
    hot = got.key.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], got.n.to_numpy(np.int64)[order]


def prints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of ``df``), node, n (shingles), fp (SimHash of the set), keys (the prefix, 8 bytes each), x0, x1, ... (parity)."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent(whole.select("text")))
    names = ["row", "node", "n", "fp", "keys", *(f"x{i}" for i in range(LONGS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, 500):  # few sets in memory at once
                b = whole.slice(low, 500)
                sets = [shingles(t.as_py()) for t in b.column(1)]
                bits = np.stack([parity(s) for s in sets])
                numbers = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([prefix(s, hot, counts).tobytes() for s in sets], pa.binary()), *(pa.array(bits[:, i].copy()) for i in range(LONGS))], names=names)

    more = StructType().add("node", "long").add("n", "integer").add("fp", "long").add("keys", "binary")
    for i in range(LONGS):
        more = more.add(f"x{i}", "long")
    return whole.mapInArrow(run, StructType([whole.schema["row"], *more.fields]))


def _prefix_rows(nodes: DataFrame) -> DataFrame:
    """key, node, n, pos of each place in a prefix. nodes: node, n, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                keys = [np.frombuffer(k.as_py(), np.int64) for k in b.column(2)]
                size = [len(k) for k in keys]
                node, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(node, size)), pa.array(np.repeat(n, size)), pa.array(pos)], names=["key", "node", "n", "pos"])

    return nodes.select("node", "n", "keys").mapInArrow(run, "key long, node long, n int, pos int")


def _may(a: str, b: str) -> Column:
    """Whether the sizes and parities of two nodes (columns named with these endings) allow the similarity."""
    n, m = F.col("n" + a), F.col("n" + b)
    differ = sum((F.bit_count(F.col(f"x{i}{a}").bitwiseXOR(F.col(f"x{i}{b}"))) for i in range(LONGS)), F.lit(0))
    return (OF * F.least(n, m) >= SHARE * F.greatest(n, m)) & ((OF + SHARE) * differ <= (OF - SHARE) * (n + m))


def _sided(df: DataFrame, end: str, *kept: str) -> DataFrame:
    return df.select(*kept, *(F.col(c).alias(c + end) for c in df.columns if c not in kept))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs (nodea, nodeb) that are similar. texts: node, text; they are fetched for the nodes of the pairs. Texts travel, not sets: they are smaller."""
    own_asked = asked = saved(pairs.select(F.col("nodea").alias("node")).union(pairs.select("nodeb")).distinct(), "shingle-asked")
    if asked.count() <= FEW:
        asked = F.broadcast(asked)  # at most FEW numbers; else texts are dealt out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                held[node] = shingles(text.as_py())
            return held[node]

        for b in batches:
            near = [similar(of(u, x), of(v, y)) for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    own = saved(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]), "shingle-texts")
    met = pairs.join(_sided(own, "a"), "nodea").join(_sided(own, "b"), "nodeb")
    links = saved(met.select("nodea", "nodeb", "texta", "textb").mapInArrow(compare, "u long, v long"), "shingle-links")
    for x in (own, own_asked):
        dropped(x)
    return links


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("nodea"), F.greatest(a, b).alias("nodeb"))


def _allowed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The distinct pairs whose sizes and parities allow the similarity. sizes: node, n, x0, ..."""
    told = pairs.distinct().join(_sided(sizes, "a"), "nodea").join(_sided(sizes, "b"), "nodeb")
    return saved(told.filter(_may("a", "b")).select("nodea", "nodeb"), "shingle-pairs")


def similar_links(found: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(u, v) edges that connect what pairs of similar nodes connect. found: as ``prints`` gives."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = saved(found.drop("row", "keys").dropDuplicates(["node"]), "shingle-nodes")
    sizes, texts = nodes.drop("fp"), found.select("node", found["row"][text_col].alias("text"))
    # The tree's pairs: fingerprints by one node each, and the other nodes with the same fingerprint.
    heads = saved(nodes.groupBy("fp").agg(F.min("node").alias("head")), "shingle-fps")
    close = close_links(heads.select("fp"), bits).join(_sided(heads.withColumnRenamed("fp", "u"), "a", "u"), "u").join(_sided(heads.withColumnRenamed("fp", "v"), "b", "v"), "v")
    near = _pairs(close, "heada", "headb").union(_pairs(nodes.join(heads, "fp"), "node", "head"))
    rows = _prefix_rows(found).repartition(parts, "key")
    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    shared = saved(rows.join(ends.hint("shuffle_hash"), "key").drop("hi").dropDuplicates(["key", "node"]), "shingle-keys")  # dealt out by key once
    tidy(spark)
    tried = _allowed(near.union(_pairs(shared, "node", "lo")), sizes)
    links = _links(tried, texts)

    def mixed(links: DataFrame) -> DataFrame:
        """Prefix places with the root of their node, where a shingle has several roots."""
        tidy(spark)
        edges = components(links)
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        rooted = shared.select("key", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        out = saved(rooted.join(several, "key", "left_semi"), "shingle-mixed")
        dropped(edges)
        return out

    rest = mixed(links)
    order = [F.xxhash64("node", F.lit(k)) for k in range(STARS)]
    stars = rest.groupBy("key").agg(*(F.min_by(c, order[k]).alias(f"{c}{k}") for k in range(STARS) for c in ("node", "root")))
    star = rest.join(stars, "key").select("node", F.explode(F.array(*(F.when(F.col("root") != F.col(f"root{k}"), F.col(f"node{k}")) for k in range(STARS)))).alias("star"))
    more = _allowed(_pairs(star, "node", "star").distinct().join(tried, ["nodea", "nodeb"], "left_anti"), sizes)
    links, tried = links.union(_links(more, texts)), tried.union(more)
    dropped(rest)
    several = mixed(links)
    rest = several.join(sizes.drop("n"), "node")
    # At the first shingle that two sets share, what they can share at most is known from its places.
    n, most = F.col("na") + F.col("nb"), F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    can = (F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & ((SHARE + OF) * most >= SHARE * n) & _may("a", "b")
    last = _sided(rest, "a", "key").join(_sided(rest, "b", "key"), "key").filter(can).select("nodea", "nodeb").distinct()
    left = saved(last.join(tried, ["nodea", "nodeb"], "left_anti"), "shingle-pairs")
    for x in (several, tried, shared, heads):
        dropped(x)
    links = links.union(_links(left, texts))
    for x in (left, nodes):
        dropped(x)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows as ``prints`` gives them, and one row per distinct set: node, least (its smallest id), root, component_id."""
    found = saved(prints(df, text_col), "shingle-prints")
    links = similar_links(found, text_col)
    tidy(df.sparkSession)
    links, linked = components(links), links
    dropped(linked)
    nodes = found.groupBy("node").agg(F.min(found["row"][id_col]).alias("least"))
    rooted = saved(nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "shingle-nodes")
    dropped(links)
    return found, rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "least", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: one with the smallest id (null if it has no other) and, of the sets with that id, the least.
    Of several rows with that id and set, one stays."""
    found, near = near_duplicates(df, id_col, text_col)
    heads = near.filter("least <=> component_id").groupBy("root").agg(F.min("node").alias("node"), F.first("component_id").alias("id"))
    own = found.select("row", "node", found["row"][id_col].alias("own"))
    # Rows of a head, mostly one: only where there are more are rows dealt out to choose.
    count = own.groupBy("node", "own").agg(F.count(F.lit(1)).alias("rows"))
    heads = saved(heads.join(count, "node").filter(F.col("own").eqNullSafe(F.col("id"))).select(F.col("node").alias("head"), "id", "rows"), "shingle-heads")
    dropped(near)
    tidy(df.sparkSession)
    kept = own.join(heads, (F.col("node") == F.col("head")) & F.col("own").eqNullSafe(F.col("id")))
    return kept.filter("rows = 1").select("row.*").unionByName(kept.filter("rows > 1").dropDuplicates(["node"]).select("row.*"))
