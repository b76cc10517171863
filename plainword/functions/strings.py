"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, 1, i) == F.substring(b, 1, i))
    return F.array_max(same)


def common_suffix_length(a: Column, b: Column) -> Column:
    return common_prefix_length(F.reverse(a), F.reverse(b))


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """Length. A fold over the characters of ``a`` carries one row of the table, itself folded over the characters of ``b``."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    row0 = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        places = F.transform(chars(b), lambda d, j: F.struct(d.alias("d"), j.alias("j")))

        def cell(done: Column, p: Column) -> Column:
            best = F.greatest(F.element_at(done, -1), F.get(row, p["j"] + 1))
            return F.concat(done, F.array(F.when(p["d"] == c, F.greatest(best, F.get(row, p["j"]) + 1)).otherwise(best)))

        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars(a), row0, step), -1)


def remove_repetition(s: Column) -> Column:
    """A character four or more times: three stay. Then a pair of characters three or more times: two stay."""
    return F.regexp_replace(F.regexp_replace(s, r"(.)\1{3,}", "$1$1$1"), r"(..)\1{2,}", "$1$1")


def remove_punct_repetition(s: Column) -> Column:
    return F.regexp_replace(s, r"(\p{Punct})\1{3,}", "$1$1$1")


def word_tokens(s: Column, collapse: bool = True) -> Column:
    """Lower-case words that begin the text or follow a space: a letter, then letters, hyphens and apostrophes."""
    low = F.lower(s)
    return F.regexp_extract_all(remove_repetition(low) if collapse else low, F.lit(r"(?<![^ ])[a-z][a-z\-']*"), F.lit(0))


def is_word(s: Column) -> Column:
    """A word of at least two ASCII characters, with perhaps a leading digit and one apostrophe."""
    return s.rlike(r"^\d?[a-z]+[a-z0-9]*'?[a-z]+$")


def is_normalisable(s: Column) -> Column:
    return s.rlike(r"^\w[\w\-\d']*$")


def is_punctuation(s: Column) -> Column:
    return s.rlike(r"^\p{Punct}+$")


def canonical_key(s: Column, collapse: bool = True) -> Column:
    """First four characters of each word token."""
    return F.transform(word_tokens(s, collapse), lambda x: F.substring(x, 1, 4))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def squeeze_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\s\p{Zs}]+", " "))


def html_unescape(s: Column) -> Column:
    """``&amp;`` first, then all entities, so doubly escaped text comes out plain."""
    return F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.replace(s, F.lit("&amp;"), F.lit("&")))


def truncate_places(x: Column, places: int) -> Column:
    return F.floor(x * F.lit(10.0**places)) / F.lit(10.0**places)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.slice(tokens, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(tokens: Column, n: int) -> Column:
    """``ngrams``, each as one string."""
    return F.transform(ngrams(tokens, n), join_tokens)


def context_left(tokens: Column, width: int, i: Column) -> Column:
    first = F.greatest(i - width, F.lit(0))
    return F.slice(tokens, first + 1, i - first)


def context_right(tokens: Column, width: int, i: Column) -> Column:
    return F.slice(tokens, i + 2, F.least(F.lit(width), F.size(tokens) - i - 1))


def indexed(tokens: Column, start: int = 0) -> Column:
    return F.transform(tokens, lambda x, i: F.struct((i + start).alias("i"), x.alias("x")))


def at_least(tokens: Column, n: int, predicate) -> Column:
    return F.lit(True) if n <= 0 else F.size(F.filter(tokens, predicate)) >= n


def is_subsequence(word: Column, chars: str) -> Column:
    import re

    return word.rlike("(?s)" + ".*".join(re.escape(c) for c in chars))
