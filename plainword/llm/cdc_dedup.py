"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: h = 2 h + gear[byte], of which the bits looked at depend on the last 16 bytes only. Where they are all
zero a chunk may end, so cuts follow content, and an insertion moves only the cuts beside it. Chunks have 16 to 512 bytes and mean 48. They meet by a 128-bit digest.
A digest found in two or more documents is repeated; the chunks of a hot digest meet its first document in salted parts. Consecutive repeated chunks of a document join to a span.
A passage that is repeated begins and ends within chunks, so it can be longer than its span, but not by the chunks beside it: a span counts if
it has ``SPAN_WORDS`` words, and with those chunks it would have ``PASSAGE_WORDS``.
Of each repeated chunk the occurrence in the document with the smallest id stays; others are to drop.

Null and empty texts have no chunks. Rows with the same id count as one document, so they don't repeat each other, but each has spans of its own: a row is told by
its id and a digest of its text. A row without an id is the document of all rows without an id and with its text; such documents come last in order.
Ids have to be integers. An empty table gives an empty result. Only the id and text columns are read, and the names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes that decide a cut; bits of the hash that have to be zero; least and most bytes of a chunk.
REACH, MASK, LEAST, MOST = 16, np.uint32(0x1F << 11), 16, 512
#: Words in a span, at least; and words of the passages looked for, at least.
SPAN_WORDS, PASSAGE_WORDS = 20, 51
#: A digest with more than one in ``HOT`` of all chunks is hot (so fewer than ``HOT`` are); its chunks are joined in ``SALTS`` parts.
HOT, SALTS = 1000, 64
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: all bytes at once, by doubling the reach of partial sums four times."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
        step *= 2
    return np.flatnonzero(h & MASK == 0) + 1


def cut_points(data: np.ndarray, at: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one text; the last is its length."""
    out, last = [], 0
    for p in (candidates(data) if at is None else at).tolist():
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST:
            out.append(p)
            last = p
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


ROW = ["uid", "bare", "digest"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """uid, bare (has no id), digest: the id (or a hash of the text), and a hash of the text."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return [F.coalesce(own, F.xxhash64(text)).alias("uid"), own.isNull().alias("bare"), F.xxhash64(text, F.lit(1)).alias("digest")]


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, bare, digest, seq, again (seen before in this row), start, end (code points), words (those that begin in it, in the chunk before, in the chunk after: 10 bits each), d1, d2 (its digest)."""
    narrow = df.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [*ROW, "seq", "again", "start", "end", "words", "d1", "d2"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names]

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds)], names=names)
            for c in cols:
                c.clear()
            return out

        held = 0
        for b in batches:
            for *key, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                raw = t.as_py().encode()
                if not raw:
                    continue
                data = np.frombuffer(raw, np.uint8)
                first = (data & 0xC0) != 0x80  # first bytes of code points
                ends = np.array(cut_points(data))
                if not first.all():  # a cut inside a code point moves to its end
                    nxt = np.append(np.flatnonzero(first), len(data))
                    ends = np.unique(nxt[np.searchsorted(nxt, ends)])
                points = np.concatenate(([0], np.cumsum(first)))
                blank = space[data]
                begins = np.concatenate(([0], np.cumsum(~blank & np.concatenate(([True], blank[:-1])))))
                starts = np.concatenate(([0], ends[:-1]))
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]), ">i8").reshape(-1, 2).astype(np.int64)
                _, firsts = np.unique(digest, axis=0, return_index=True) if len(digest) > 1 else (None, np.zeros(1, np.int64))
                again = np.ones(len(ends), bool)
                again[firsts] = False
                own = begins[ends] - begins[starts]
                words = own | np.append(0, own[:-1]) << 10 | np.append(own[1:], 0) << 20
                n = len(ends)
                for c, v in zip(cols, (*(np.full(n, x) for x in key), np.arange(n), again, points[starts], points[ends], words, digest[:, 0].copy(), digest[:, 1].copy())):
                    c.append(v)
                held += len(ends)
                if held >= 50_000:
                    yield full()
                    held = 0
        if held:
            yield full()

    return narrow.mapInArrow(run, "uid long, bare boolean, digest long, seq int, again boolean, start int, end int, words int, d1 long, d2 long")


def _spans(df: DataFrame, id_col: str, text_col: str, span_words: int, passage_words: int) -> DataFrame:
    every = chunks(df, id_col, text_col)
    known, bare = F.when(~F.col("bare"), F.col("uid")), F.when(F.col("bare"), F.col("uid"))
    found = every.groupBy("d1", "d2").agg(F.min(known).alias("a"), F.max(known).alias("b"), F.min(bare).alias("c"), F.max(bare).alias("d"), F.count(F.lit(1)).alias("n"))
    several = (F.col("a") != F.col("b")) | (F.col("c") != F.col("d")) | (F.col("a").isNotNull() & F.col("c").isNotNull())
    shared = saved(found.filter(several).select("d1", "d2", F.coalesce("a", "c").alias("first"), F.col("a").isNull().alias("first_bare"), "n"), "chunks")
    least = (shared.agg(F.sum("n")).first()[0] or 0) // HOT
    on = ["d1", "d2"]
    if least:
        hot = F.broadcast(shared.filter(F.col("n") > least).select("d1", "d2", F.lit(SALTS).alias("parts")))
        salt = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("uid", "seq"), F.lit(SALTS)).cast("int"))
        every = every.join(hot, on, "left").withColumn("salt", salt).drop("parts")
        parts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        shared, on = shared.withColumn("salt", F.explode(parts)), [*on, "salt"]
    dropped = (F.col("uid") != F.col("first")) | (F.col("bare") != F.col("first_bare")) | F.col("again")
    met = every.join(shared, on).select(*ROW, "seq", "start", "end", "words", "first", dropped.alias("dropped"))
    met = met.repartition(*ROW).dropDuplicates([*ROW, "seq"])  # equal rows; the deal serves the window and the spans too
    run = Window.partitionBy(*ROW, "dropped").orderBy("seq")
    grouped = met.withColumn("run", F.col("seq") - F.row_number().over(run))
    own = lambda by: F.shiftright("words", by).bitwiseAND(F.lit(1023))
    spans = grouped.groupBy(*ROW, "dropped", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(own(0)).alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min_by("first", "seq").alias("first_doc_id"),
        (F.min_by(own(10), "seq") + F.max_by(own(20), "seq")).alias("beside"),
    )
    return spans.filter((F.col("n_words") >= span_words) & (F.col("n_words") + F.col("beside") >= passage_words))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per span: doc_id, start, end (code points, exclusive), n_words, n_chunks, first_doc_id (smallest id that has its first chunk), dropped.

    Spans that stay where they are (first occurrences) are listed with ``dropped`` false. For a row without an id, ``doc_id`` is the hash of its text that names its document."""
    spans = _spans(df, id_col, text_col, span_words, passage_words)
    return spans.select(F.col("uid").alias("doc_id"), F.col("start").cast("long"), F.col("end").cast("long"), "n_words", "n_chunks", "first_doc_id", "dropped")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = SPAN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``df`` with the dropped spans cut out of its texts; other columns as they are. Spans of a text, at most one for each 16 bytes, meet in one row."""
    spans = _spans(df, id_col, text_col, span_words, passage_words).filter("dropped").groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    met = whole.join(spans, ROW, "left")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
    piece = lambda x, i: F.substring(F.col("text"), (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int"))
    rest = F.expr("substring(text, cast(element_at(spans, -1).end + 1 as int))")
    cut = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut)
    return met.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))
