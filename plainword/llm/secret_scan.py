"""Secret scans: three fixed patterns, and windows of high Shannon entropy within candidate strings.

A candidate is a run of token characters of at least ``WINDOW`` characters, without the filler in it and cut at its ``-``, ``_``, ``/`` and ``=`` where a piece is long enough
by itself, so what stands beside a key neither hides it nor changes its class. Of each class of characters, the entropy of each window
follows from the last one by two changed counts. Overlapping windows over their class's threshold join to one span. Spans that an allow-list
pattern matches as a whole, and those within a base span, are left out.

Null text counts as empty; empty texts have no spans. Rows are scanned one by one and whole: ties, repeats, null ids and empty
tables give a row per input row. Only the id and text columns are read, so other names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base scan: kinds in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is what is left of [0-9a-f]+ once shorter matches are dropped
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Bits per character that a window of each class must reach. Random windows of 20 come near 3.3 (hex), 3.8 and 4.0.
THRESHOLDS = {"hex": 2.9, "lower_digit": 3.5, "mixed": 3.7}
#: What parts a candidate: a stretch of one to four characters five times or more, and marks between words.
FILLER = re.compile(r"(.{1,4}?)\1{4,}")
MARKS = re.compile(r"[-_/=]+")
UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
#: Spans that look random and are none, if all of the span matches.
ALLOW = [
    re.compile(r"[A-Za-z]+"),  # a long word
    re.compile(r"[0-9]+"),  # a number
    re.compile(r"(?i)(example|placeholder|changeme|x|abcdef|0?123456789?|[-_/=.+]|(?<![a-z])[a-z]{1,12}(?![a-z]))+"),  # names of placeholders, words in a path or slug
]

_TERM = [0.0] + [c / WINDOW * math.log2(c / WINDOW) for c in range(1, WINDOW + 1)]


def char_class(s: str) -> str | None:
    """hex, lower_digit or mixed; None for strings without both a letter and a digit."""
    lower, upper, digit = (any(a <= c <= z for c in s) for a, z in ("az", "AZ", "09"))
    if not digit or not (lower or upper):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "mixed" if lower and upper else "lower_digit"


def hot_spans(s: str, least: float) -> Iterator[tuple[int, int]]:
    """Joined windows of ``s`` whose entropy is at least ``least``. Each step changes two counts."""
    window, counts = WINDOW, {}
    negated = 0.0
    start = end = -1
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        negated += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= window - 1:
            if -negated >= least - 1e-9:
                if start >= 0 and i + 1 - window <= end:
                    end = i + 1
                else:
                    if start >= 0:
                        yield start, end
                    start, end = i + 1 - window, i + 1
            old = s[i + 1 - window]
            n = counts[old]
            negated += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
    if start >= 0:
        yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def pieces(s: str) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that are judged by themselves: filler out, then cut at marks where a part between them is long enough, else whole."""
    ends = [m.span() for m in FILLER.finditer(s)]
    for low, high in zip([0, *(e for _, e in ends)], [*(b for b, _ in ends), len(s)]):
        if high - low < WINDOW:
            continue
        marks = [m.span() for m in MARKS.finditer(s, low, high)]
        parts = [(a, z) for a, z in zip([low, *(e for _, e in marks)], [*(b for b, _ in marks), high]) if z - a >= WINDOW]
        yield from parts or [(low, high)]


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        for low, high in pieces(m[0]):
            part = m[0][low:high]
            kind = char_class(part)
            if kind is None:
                continue
            for a, b in hot_spans(part, THRESHOLDS[kind]):
                a, b = a + low + m.start(), b + low + m.start()
                if not any(p.fullmatch(text[a:b]) for p in ALLOW) and not _uuid(m[0], m.start(), a, b) and not any(s <= a and b <= e for s, _, e in base):
                    out.append((a, 3, b))
    return out


def _uuid(candidate: str, at: int, a: int, b: int) -> bool:
    """Whether the span lies in an identifier of the candidate."""
    return any(m.start() + at <= a and b <= m.end() + at for m in UUID.finditer(candidate))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, joined = ([], [], [], []), [], []
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                more = entropy_spans(text, base)
                for k in range(4):
                    counts[k].append(sum(1 for s in (more if k == 3 else base) if s[1] == k))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
