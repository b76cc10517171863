"""Benchmark decontamination by latent semantic retrieval.

1. ``term_rows``: one pass over all documents writes the hashed terms of their passages and counts in how many documents each term occurs.
2. ``latent_basis``: randomised SVD of TF-IDF passages. Rows are the passages of all documents, each word in one of them, and the benchmark's items, the
   latter with enough weight to shape the space. Workers return A'(A X) for their rows; the driver keeps only terms x dimensions.
3. ``Retriever``: each text is cut into blocks of words; windows of blocks, as long as the items, get latent vectors, and those with a
   cosine to an item of at least ``COSINE`` are candidates.
4. Besides, an item is a candidate wherever its rarer words stand close enough that a leak can't be ruled out (prefix filter on weights): every
   leak by the rule below has such a place, so none is missed for its latent vector or the place of the blocks.
5. The rule (``Retriever.judge``). A region of ``region_size`` words that begins at a word of the item leaks it if
   * of the item's weight, the sum of its words' inverse document frequencies, the region holds ``BAG`` (a word counts as often as the item has it),
   * the longest common subsequences of the item's two halves with the region cover ``LCS`` of its words, so halves may change places,
   * that of its answer (its last words) covers ``ANSWER`` of it, or both halves together ``SURE``.

Items of more than ``LONGEST`` words are judged by parts of that length, the last one at the item's end: one part is a leak of the item.
Items of fewer than ``LEAST_WORDS`` words match only where they stand word for word.

Basis, frequencies, windows and search cover all rows and whole texts. The benchmark is taken in blocks of ``ITEMS`` items,
one at a time, so neither what is broadcast nor what the driver holds grows with it.
Null and empty texts and items match nothing. Rows with equal ids are matched one by one and give equal pairs once; equal items each match.
Null ids pass through. An empty corpus or benchmark gives an empty result. Only the id and text columns are read, so other names can't clash.
"""

from __future__ import annotations

import ctypes
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved

TERMS, DIMENSIONS, EXTRA = 1 << 15, 64, 12
ITEMS, SEED = 2000, 17
BLOCK = 8
LENGTHS = (8, 16, 24, 32, 48, 64)
LONGEST = LENGTHS[-1]
COSINE, SHARE = 0.6, 0.5
BAG, LCS, ANSWER, SURE = 0.5, 0.5, 0.37, 0.8
LEAST_WORDS, ANSWER_WORDS = 8, 8
#: Share of an item's weight that its rarer words have to show in one region. More lets commoner words in; any share loses nothing.
SHOWN = 0.25
#: Bytes of texts that are searched together, and blocks whose vectors are in memory at once.
TOGETHER, PART = 1 << 19, 1 << 13
#: Words of a passage at most, passages whose products are added together, those that are multiplied at once (so they stay in the cache), and rows that are added in one go.
PASSAGE, SOME, FEW, RUN = 32, 1 << 14, 1 << 10, 32

_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»‘’“”–—…"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts in lower case and without punctuation at their edges, the place there of each word in order, and where each text's
    words begin (and the last one's end)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    code, starts = coded.indices.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    starts = starts - starts[0]
    blank = pc.index(coded.dictionary, "").as_py()  # beside white space at the edges
    if blank >= 0:
        full = code != blank
        starts = np.concatenate(([0], np.cumsum(full)))[starts]
        code = code[full]
    return pc.utf8_trim(coded.dictionary, characters=_EDGE), code, starts


def terms(words: pa.Array) -> np.ndarray:
    """Hashed terms of some words."""
    return np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(words)) % TERMS


def tokens(text: str | None) -> list[str]:
    """A text's words, without those that are punctuation only."""
    words, code, _ = split_words(pa.array([text], pa.string()))
    words = words.to_pylist()
    return [words[c] for c in code if words[c]]


def term(w: str) -> int:
    return zlib.crc32(w.encode()) % TERMS


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of some texts of about ``TOGETHER`` bytes, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, side="right")))
        yield texts.slice(low, high - low)
        low = high


def _release() -> None:
    """Gives memory that was freed back to the system: a worker that is kept for later tasks else holds it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lcs_length(a: list, b: Iterable) -> int:
    """Longest common subsequence of two word lists; a row of the table is the bits of one integer (Hyyro, 2004)."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    return _lcs(at, len(a), b)


def _lcs(at: dict, n: int, b: Iterable) -> int:
    row = full = (1 << n) - 1
    for w in b:
        m = at.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def _passages(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to ``PASSAGE`` terms, sorted and filled up with ``TERMS``, and how many each text has: as few as hold all its words, even in length."""
    size = np.diff(starts)
    many = -(-size // PASSAGE)
    text = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    length = (k + 1) * size[text] // many[text] - k * size[text] // many[text]
    out = np.full((len(text), PASSAGE), TERMS, np.uint16)
    out[np.arange(PASSAGE) < length[:, None]] = ids
    out.sort(axis=1)
    return out, many


def term_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Written to the shared folder: for each document with words the terms of its passages, and from each task the documents with each term (``term``, ``n``),
    all documents (term -1) and all passages (term -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "n", "passages"]
        seen, n, rows = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            for texts in together(b.column(0)):
                n += len(texts)
                words, code, starts = split_words(texts)
                ids = terms(words)[code]
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
                seen += np.bincount(pd.unique(doc * TERMS + ids) % TERMS, minlength=TERMS)
                some, many = _passages(ids, starts)
                rows += len(some)
                ends = np.cumsum(many[many > 0]) * PASSAGE * some.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(some)])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.int64()), held], names=names)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, (-1, -2))), pa.array(np.append(seen[at], (n, rows))), pa.nulls(len(at) + 2, pa.binary())], names=names)
        _release()

    return saved(df.select(F.col(text_col)).mapInArrow(run, "term long, n long, passages binary"), "terms")


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents with each hashed term, all documents and all passages, from ``term_rows``."""
    got = rows.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS, np.int64)
    own = got[got.term >= 0]
    out[own.term.to_numpy()] = own.n.to_numpy()
    return out, int(got[got.term == -1].n.sum()), int(got[got.term == -2].n.sum())


def _matrix(passages: list[np.ndarray], idf: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and values of the passages' TF-IDF rows, each of length ``weight``; a row has an entry for each word."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    ids = np.concatenate(passages).astype(np.int64)
    value = idf[ids]
    order = np.lexsort((ids, row))
    row, ids, value = row[order], ids[order], value[order]
    same = np.concatenate(([False], (row[1:] == row[:-1]) & (ids[1:] == ids[:-1])))
    at = np.flatnonzero(~same)
    tf = np.diff(np.append(at, len(row)))
    row, ids, value = row[at], ids[at], value[at] * tf
    norm = np.sqrt(np.bincount(row, value**2, len(passages)))
    return row, ids, (value * weight / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def _gram_times(row: np.ndarray, ids: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x)."""
    out = np.zeros_like(x)
    if len(row):
        ax = np.add.reduceat(x[ids] * value[:, None], np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))))
        rank = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))
        by = np.argsort(ids, kind="stable")
        part = ax[rank[by]] * value[by][:, None]
        starts = np.flatnonzero(np.concatenate(([True], ids[by][1:] != ids[by][:-1])))
        out[ids[by][starts]] = np.add.reduceat(part, starts)
    return out


def _sums(key: np.ndarray, rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their ``v[rows]``; the keys are sorted. Runs of up to ``RUN`` rows are added side by side, then their sums likewise."""
    while True:
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        if len(head) == len(key):
            return key, v[rows]
        end = np.append(head[1:], len(key))
        many = -(-(end - head) // RUN)
        begin = np.repeat(head, many) + RUN * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        lack = (RUN - np.minimum(RUN, np.repeat(end, many) - begin)).astype(np.uint8)
        order = np.argsort(lack, kind="stable")  # the longest run first
        first, lack = begin[order], lack[order]
        out = v[rows[first]]
        more = np.empty_like(out)
        for k in range(1, RUN - int(lack[0])):
            m = int(np.searchsorted(lack, RUN - k))
            out[:m] += np.take(v, rows[first[:m] + k], 0, more[:m], "clip")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        key, rows, v = key[begin], back, out


def _gram_passages(passages: np.ndarray, weighted: np.ndarray, energy: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A x), but for the last factor ``idf``, of rows as ``_passages`` gives them. weighted: x by ``idf``, and zeros for term TERMS; energy: squares of ``idf``."""
    for low in range(0, len(passages), SOME):
        some = passages[low : low + SOME]
        flat = some.ravel()
        square = energy[some].sum(1)
        at = np.flatnonzero(flat[1:] == flat[:-1]) + 1
        at = at[flat[at] < TERMS]
        for k in range(1, PASSAGE):  # a term that occurs n times weighs n squared: all its pairs in the row
            at = at[at % PASSAGE >= k]
            at = at[flat[at] == flat[at - k]]
            if not len(at):
                break
            square += 2 * np.bincount(at // PASSAGE, energy[flat[at]], len(some)).astype(np.float32)
        ax = np.empty((len(some), weighted.shape[1]), np.float32)
        more = np.empty((min(FEW, len(some)), weighted.shape[1]), np.float32)
        for i in range(0, len(some), FEW):
            own = ax[i : i + FEW]
            place = some[i : i + FEW].T.astype(np.intp, "C")
            np.take(weighted, place[0], 0, own, "clip")
            for k in range(1, PASSAGE):
                own += np.take(weighted, place[k], 0, more[: len(own)], "clip")
        ax /= np.maximum(square, 1e-12)[:, None]
        by = np.argsort(flat, kind="stable")
        key, part = _sums(flat[by], by // PASSAGE, ax)
        total[key] += part


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """Orthonormal columns with the span of ``y``, by two rounds of Cholesky QR: only small matrices are held in double precision."""
    for _ in range(2):
        gram = sum(y[i : i + 2048].T.astype(np.float64) @ y[i : i + 2048] for i in range(0, len(y), 2048))
        gram += np.eye(len(gram)) * max(np.trace(gram) * 1e-10, 1e-30)
        y = (y @ np.linalg.inv(np.linalg.cholesky(gram)).T.astype(np.float32)).astype(np.float32)
    return y


def latent_basis(rows: DataFrame, n: int, items: list[str], idf: np.ndarray, rounds: int = 2) -> np.ndarray:
    """(TERMS, DIMENSIONS): leading right singular vectors. rows: ``term_rows`` with ``n`` passages; the items together weigh four times as much."""
    width = DIMENSIONS + EXTRA
    own = [p for t in items for p in [np.array([term(w) for w in tokens(t)])] if len(p)]
    heavy = _matrix(own, idf, float(np.sqrt(4 * max(1, n) / max(1, len(own))))) if own else None
    x = _orthonormal(np.random.default_rng(SEED).standard_normal((TERMS, width), np.float32))
    sc, schema = rows.sparkSession.sparkContext, "term long, part binary"
    # Each task's sums have a row for nearly every term, however little it reads: tasks follow the passages, not the files.
    passages = rows.filter(F.col("passages").isNotNull()).select("passages").coalesce(max(sc.defaultParallelism, n // SOME))
    for _ in range(rounds):
        shared = sc.broadcast((x, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x, idf = shared.value
            weighted, energy = np.append(x * idf[:, None], np.zeros_like(x[:1]), 0), np.append(idf**2, np.float32(0))
            total = np.zeros_like(weighted)
            for b in batches:
                _gram_passages(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16).reshape(-1, PASSAGE), weighted, energy, total)
            total = total[:TERMS] * idf[:, None]
            del weighted
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i].tobytes() for i in at], pa.binary())], names=["term", "part"])
            del total
            _release()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for t, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v = np.frombuffer(part, np.float32)
                    if t in out:
                        out[t] += v
                    else:
                        out[t] = v.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in out.values()], pa.binary())], names=["term", "part"])

        got = passages.mapInArrow(run, schema).repartition("term").mapInArrow(add, schema).toArrow()
        y = _gram_times(*heavy, x) if heavy else np.zeros_like(x)
        for b in got.to_batches(1000):
            y[b.column("term").to_numpy()] += np.frombuffer(b"".join(b.column("part").to_pylist()), np.float32).reshape(b.num_rows, -1)
        del got
        shared.destroy()
        small = (x.T @ y).astype(np.float64)
        q, x = x, _orthonormal(y)
    small = (x.T @ y).astype(np.float64) @ (q.T @ x).astype(np.float64)  # A'A in the last basis, seen through the one before
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (x @ turn[:, ::-1][:, :DIMENSIONS].astype(np.float32)).astype(np.float32)


def region_size(n: int) -> int:
    """Words of a text that are judged together for an item of ``n`` words."""
    return n + n // 2 + 2 * BLOCK


def parts_of(w: list[str]) -> list[list[str]]:
    """The item, or parts of it if it is long; the last one ends where it ends."""
    if len(w) <= LONGEST:
        return [w]
    return [w[i : i + LONGEST] for i in (*range(0, len(w) - LONGEST, LONGEST), len(w) - LONGEST)]


class Item:
    """A part of an item as codes of its words, with what its rule needs."""

    def __init__(self, key: object, w: list[int], weight: list[float]):
        self.key, self.words, self.size = key, w, region_size(len(w))
        self.counts = {x: w.count(x) for x in w}
        self.weights = {x: weight[x] for x in self.counts}
        self.total = sum(self.weights[x] * n for x, n in self.counts.items())
        half = (len(w) + 1) // 2
        self.tail_size = min(ANSWER_WORDS, max(1, len(w) // 3))
        self.halves = [(self._places(x), len(x)) for x in (w[:half], w[half:])]
        self.tail = self._places(w[-self.tail_size :])

    @staticmethod
    def _places(w: list[int]) -> dict[int, int]:
        at: dict[int, int] = {}
        for i, x in enumerate(w):
            at[x] = at.get(x, 0) | 1 << i
        return at

    def shares(self, part: list[int]) -> tuple[float, float]:
        """Of its words by halves, and of its answer, what the longest common subsequences with the region cover."""
        return sum(_lcs(at, n, part) for at, n in self.halves) / len(self.words), _lcs(self.tail, self.tail_size, part) / self.tail_size

    def leaks(self, part: list[int]) -> tuple[float, float] | None:
        """The shares, if they are a leak's."""
        share, answer = self.shares(part)
        return (share, answer) if share >= SURE or share >= LCS and answer >= ANSWER else None


class Retriever:
    """Finds the items that a text holds."""

    def __init__(self, items: list[tuple[object, str]], idf: np.ndarray, basis: np.ndarray):
        self.padded = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)  # term TERMS stands for no word
        self.padded_energy = np.append(idf**2, 0).astype(np.float32)
        self.code: dict[str, int] = {}
        weight: list[float] = []
        self.items: list[Item] = []
        self.short: dict[int, list[tuple[object, list[int]]]] = defaultdict(list)
        by = defaultdict(list)
        rare: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for key, text in items:
            whole = tokens(text)
            for w in whole:
                if w not in self.code:
                    self.code[w] = len(self.code)
                    weight.append(float(idf[term(w)]))
            if 0 < len(whole) < LEAST_WORDS:
                codes = [self.code[w] for w in whole]
                self.short[codes[0]].append((key, codes))
                continue
            for part in parts_of(whole) if whole else []:
                n = len(self.items)
                item = Item(key, [self.code[w] for w in part], weight)
                self.items.append(item)
                ids = [term(w) for w in part]
                z = self.padded[ids].sum(0)
                norm = max(float(np.linalg.norm(z)), 1e-12)
                kept = norm / float(np.sqrt(self.padded_energy[ids].sum()))
                by[min(LENGTHS, key=lambda m, size=len(part): abs(m - size))].append((n, z / norm, kept))
                shown = 0.0
                for x in sorted(item.counts, key=lambda x: (-item.weights[x], x)):
                    if shown >= (1 - BAG + SHOWN) * item.total:
                        break
                    shown += item.weights[x] * item.counts[x]
                    rare[x].append((n, item.weights[x] / item.total))
        self.by = {size: (np.array([n for n, _, _ in x]), np.array([z for _, z, _ in x], np.float32), np.array([k for _, _, k in x], np.float32)) for size, x in by.items()}
        sizes = np.array([len(rare[x]) for x in range(len(self.code))], np.int64)
        self.rare_size = np.append(sizes, 0)
        self.rare_begin = np.append(np.cumsum(sizes) - sizes, 0)
        flat = [y for x in range(len(self.code)) for y in rare[x]]
        self.rare_item = np.array([n for n, _ in flat], np.int64)
        self.rare_share = np.array([s for _, s in flat], np.float64)
        self.region = np.array([x.size for x in self.items], np.int64)
        self.words = pa.array(self.code, pa.string())

    def candidates(self, ids: np.ndarray, starts: np.ndarray, cosine: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, last word, cosine) of windows near an item. ids: terms of the words of all texts, which begin at ``starts``.

        A short latent vector points anywhere, so besides the cosine the window has to show ``SHARE`` of the part of its length (its TF-IDF norm) that
        the latent space shows of the item. All texts lie in one row of blocks, with blocks of zeros after each, so no window sees two texts."""
        gap = LONGEST // BLOCK - 1
        size = np.diff(starts)
        blocks = -(-size // BLOCK) + gap
        first = np.concatenate(([0], np.cumsum(blocks)))
        at = np.full(int(first[-1]) * BLOCK, TERMS, np.int32)
        at[np.arange(len(ids)) + np.repeat(first[:-1] * BLOCK - starts[:-1], size)] = ids
        at = at.reshape(-1, BLOCK)
        out: list[tuple[int, int, int, int, float]] = []
        for low in range(0, len(at), PART):  # parts overlap by a window, so memory is bounded for a text of any length
            some = at[low : low + PART + gap]
            own = min(PART, len(at) - low)
            block = self.padded[some[:, 0]]
            for k in range(1, BLOCK):
                block += self.padded[some[:, k]]
            energy = self.padded_energy[some].sum(1)
            v, whole, m = block, energy, 1
            for length in LENGTHS:
                while m < length // BLOCK:
                    v, whole, m = v[:-1] + block[m:], whole[:-1] + energy[m:], m + 1
                if length not in self.by or not len(v):
                    continue
                item, z, kept = self.by[length]
                u = v[:own]
                norm = np.sqrt(np.einsum("ij,ij->i", u, u))
                dot = u @ z.T
                # The two bounds for each window as one: a window's least dot product with any item first, then item by item.
                least = np.maximum(cosine * norm, SHARE * np.sqrt(whole[: len(u)]) * kept.min())
                a, b = np.divmod(np.flatnonzero(dot >= np.maximum(least, 1e-12)[:, None]), len(item))
                d = dot[a, b]
                enough = d >= SHARE * np.sqrt(whole[a]) * kept[b]
                a, b, d = a[enough], b[enough], d[enough]
                text = np.searchsorted(first, a + low, side="right") - 1
                begin = (a + low - first[text]) * BLOCK
                out += zip(text.tolist(), item[b].tolist(), begin.tolist(), (begin + length).tolist(), (d / norm[a]).tolist())
        return out

    def close_words(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, last word) of stretches in which the item's rarer words show ``SHOWN`` of its weight within its region, by item and place."""
        at = np.flatnonzero(self.rare_size[codes])
        size = self.rare_size[codes[at]]
        if not len(at):
            return []
        flat = np.repeat(self.rare_begin[codes[at]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item, pos, share = self.rare_item[flat], np.repeat(at, size), self.rare_share[flat]
        text = np.searchsorted(starts, pos, side="right") - 1
        reach = int(self.region.max()) if len(self.region) else 0
        # Texts stand apart by more than a region, items by more than all texts: one sorted key, in which a region never sees another text or item.
        place = pos + text * reach
        span = int(starts[-1]) + len(starts) * reach + 1
        key = item * span + place
        order = np.argsort(key)
        key, item, pos, text = key[order], item[order], pos[order], text[order]
        total = np.concatenate(([0.0], np.cumsum(share[order])))
        end = np.searchsorted(key, key + self.region[item])
        ok = np.flatnonzero(total[end] - total[:-1] >= SHOWN - 1e-6)
        if not len(ok):
            return []
        low, high, item, text = pos[ok], pos[end[ok] - 1], item[ok], text[ok]
        apart = np.concatenate(([True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])))
        heads = np.flatnonzero(apart)
        last = np.maximum.reduceat(high, heads)
        begin = starts[text[heads]]
        return [*zip(text[heads].tolist(), item[heads].tolist(), (low[heads] - begin).tolist(), (last - begin).tolist())]

    def judge(self, codes: np.ndarray, n: int, a: int, b: int) -> tuple[float, float, int] | None:
        """(share, answer, place) of the best leak of item ``n`` among the regions of a text (the codes of its words) that begin at a word of the item
        and may touch its words from ``a`` to ``b``; None without one."""
        item = self.items[n]
        counts, weights, start = item.counts, item.weights, max(0, a - item.size + 1)
        own = [(i, x) for i, x in enumerate(codes[start : b + item.size].tolist()) if x in counts]
        left, need, some = dict(counts), (BAG - 1e-9) * item.total, LCS * len(item.words)  # left: of each word, what the region lacks
        if len(own) < some or sum(weights[x] * counts[x] for x in {x for _, x in own}) < need:  # too little in all regions together
            return None
        best, z, held = None, 0, 0.0
        for k, (i, first) in enumerate(own):
            while z < len(own) and own[z][0] < i + item.size:
                x = own[z][1]
                if left[x] > 0:
                    held += weights[x]
                left[x] -= 1
                z += 1
            if held >= need and z - k >= some:
                found = item.leaks([x for _, x in own[k:z]])  # other words count for nothing
                if found and (best is None or found > best[:2]):
                    best = (*found, start + i)
                    if found[0] == 1:
                        break
            left[first] += 1
            if left[first] > 0:
                held -= weights[first]
        return best

    def _cosine(self, ids: np.ndarray, n: int, at: int) -> float:
        item = self.items[n]
        size = min(LENGTHS, key=lambda m: abs(m - len(item.words)))
        which, z, _ = self.by[size]
        u = self.padded[ids[at : at + len(item.words)]].sum(0)
        return float(u @ z[int(np.flatnonzero(which == n)[0])]) / max(float(np.linalg.norm(u)), 1e-12)

    def find(self, texts: pa.Array, cosine: float = COSINE) -> Iterator[list[tuple[object, float, float, float]]]:
        """For each text the (item id, cosine, share of its words, share of its answer) of its leaks."""
        for some in together(texts):
            words, code, starts = split_words(some)
            out: list[dict[object, tuple[object, float, float, float]]] = [{} for _ in range(len(some))]
            if len(code) and (self.items or self.short):
                own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
                codes, ids = own[code], terms(words).astype(np.int32)[code]
                self._short(codes, starts, out)
                if self.items:
                    self._long(codes, ids, starts, cosine, out)
            yield from (list(x.values()) for x in out)

    def _long(self, codes: np.ndarray, ids: np.ndarray, starts: np.ndarray, cosine: float, out: list[dict]) -> None:
        near = [(t, n, max(0, a - BLOCK), b + BLOCK) for t, n, a, b, _ in self.candidates(ids, starts, cosine)]
        stretches: list[list[int]] = []
        for t, n, a, b in sorted(near + self.close_words(codes, starts)):  # each stretch is judged once, whoever found it
            if stretches and stretches[-1][:2] == [t, n] and a <= stretches[-1][3]:
                stretches[-1][3] = max(stretches[-1][3], b)
            else:
                stretches.append([t, n, a, b])
        for t, n, a, b in stretches:
            low, high = int(starts[t]), int(starts[t + 1])
            found = self.judge(codes[low:high], n, a, b)
            if found:
                key = self.items[n].key
                new = (key, self._cosine(ids[low:high], n, found[2]), *found[:2])
                if key not in out[t] or new[2:] > out[t][key][2:]:
                    out[t][key] = new

    def _short(self, codes: np.ndarray, starts: np.ndarray, out: list[dict]) -> None:
        for first, items in self.short.items():
            at = np.flatnonzero(codes == first)
            for key, w in items:
                ok = at
                for k, x in enumerate(w[1:], 1):
                    ok = ok[ok + k < len(codes)]
                    ok = ok[codes[ok + k] == x]
                for p in ok.tolist():
                    t = int(np.searchsorted(starts, p, side="right")) - 1
                    if p + len(w) <= starts[t + 1]:
                        out[t].setdefault(key, (key, 1.0, 1.0, 1.0))


def retrievers(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", items: int = ITEMS) -> Iterator[tuple[Retriever, bool]]:
    """One for each block of at most about ``items`` benchmark items, one at a time, and whether it is the last."""
    count = benchmark.count()
    if not count:
        return
    rows = term_rows(docs, text_col)
    seen, n, passages = document_frequency(rows)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    blocks = -(-count // items)
    for k in range(blocks):
        some = benchmark.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k).select(item_id, item_text).orderBy(item_id, item_text).collect()
        pairs = [(r[0], r[1]) for r in some if r[1] is not None]
        yield Retriever(pairs, idf, latent_basis(rows, passages, [t for _, t in pairs], idf)), k == blocks - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, items: int = ITEMS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, cosine, lcs, answer. With several blocks of items, each one's rows are written before the next is made."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema, of = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer double", to_arrow_type(benchmark.schema[item_id].dataType)
    found = narrow.sparkSession.createDataFrame([], schema)
    for one, last in retrievers(docs, benchmark, text_col, item_id, item_text, items):
        shared = narrow.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, rows = [], []
                for i, leaks in enumerate(shared.value.find(b.column(1), cosine)):
                    at += [i] * len(leaks)
                    rows += leaks
                cols = [*zip(*rows)] or [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], of), *(pa.array(c, pa.float64()) for c in cols[1:])], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        some = narrow.mapInArrow(run, schema)
        if not last:
            some = saved(some, "leaks")
            shared.destroy()
        found = found.unionByName(some)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def _holds_item(shared):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([bool(x) for x in shared.value.find(pa.array(s, pa.string()))], dtype=bool)

    return leaks


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that hold an item. With several blocks of items, what each keeps is written before the next is made."""
    kept = docs
    for one, last in retrievers(docs, benchmark, text_col, **settings):
        shared = docs.sparkSession.sparkContext.broadcast(one)
        kept = kept.filter(~_holds_item(shared)(F.col(text_col)))
        if not last:
            kept = saved(kept, "unleaked")
            shared.destroy()
    return kept
