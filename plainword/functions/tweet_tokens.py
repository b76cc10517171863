"""Tokeniser for tweets: some kinds of strings stay whole, brackets and quotes at the edges of words split off, the rest splits at spaces. All native.

Each kind is written from its description beside it, out of a few sets of characters. Java's regular expressions are Spark's, so each match is set
between marks in one replacement, the text is split at the marks, and every second piece is a token as it stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import html_unescape, remove_repetition, squeeze_whitespace

_MARK = "\u0001"

# Sets of characters, as bodies of a class.
_QUOTE = "'\"‘’“”"
_STOP = ".,?!…"
_OPEN, _CLOSE = r"(\[{<«", r")\]}>»"
_LINK = rf"[^\s<>{_QUOTE}]"  # what may stand in an address
_LINK_END = rf"[^\s<>{_QUOTE}.,:;?!)\]}}]"  # and what may end it

# Domain endings that make an address without anything else, and titles that keep their full stop.
ENDINGS = "aero arpa asia biz cat com coop edu gov info int jobs mil mobi museum name net org pro tel travel".split()
TITLES = "Mr Mrs Ms Dr Prof Jr Sr St vs etc".split()


def _kinds() -> dict[str, str]:
    ending, title = "|".join(ENDINGS), "|".join(TITLES)
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    path = rf"(?:/(?:{_LINK}*{_LINK_END})?)?"
    eyes, nose, smile, frown, other = "[:;=8xX]", "[-o'^]?", r"[)\]}DPp3]+", r"[(\[{|/\\]+", "[oO*@$]"
    free, over = r"(?<![^\s(\[\u0001])", rf"(?=[\s{_STOP}{_QUOTE})\]\u0001]|$)"  # where a western face may begin and end
    half = "[-^~oO0TtuU>.@*]"  # an eye, seen upright
    return {
        # less-than sign, perhaps a slash, and threes: a heart, or a broken one; a row of them is one
        "heart": r"(?:</?3+)+",
        # with a scheme or www; or a domain with a known ending; or one with a country's two letters and a path
        "url": rf"(?:[hH][tT][tT][pP][sS]?://|\b[wW]{{3}}\.){_LINK}*{_LINK_END}|(?<![@\w.-])(?:{label}\.)+(?:(?:{ending})(?:\.[a-z]{{2}})?(?![\w@-]){path}|[a-z]{{2}}/(?:{_LINK}*{_LINK_END})?)",
        # local part, at sign, domain
        "email": rf"\b[\w.%+-]+@(?:{label}\.)+[A-Za-z]{{2,}}\b",
        # numbers joined by colons
        "time": r"\b\d{1,4}(?::\d{1,4})+\b",
        # groups of three digits between commas
        "grouped_number": r"(?<![\d,])\d{1,3}(?:,\d{3})+(?![\d,]*\d)",
        # a number with inner full stops or slashes, perhaps with a currency sign or a percent sign
        "joined_number": r"\p{Sc}?\b\d+(?:[./]\d+)+%?|\p{Sc}\d+|\b\d+%",
        # faces: sideways, sideways the other way round, and upright with two like eyes, with or without a bracket around
        "emoticon": rf"{free}[>]?{eyes}{nose}(?:{smile}|{frown}|{other}){over}|{free}(?:[(\[{{]+|[)\]}}]+|[dDqo]){nose}[:;=]{over}|[(]{half}[_.-]+{half}[)]|{free}{half}_+{half}{over}|{free}([\^><])\.?\1{over}",
        # arrows of dashes or equals signs, and those that are one character
        "arrow": r"<+[-=—]+>*|[-=—]+>+|[←-⇿]+",
        # a character entity that has not been decoded
        "entity": r"&#?\w+;",
        # initials with full stops, and titles
        "abbreviation": rf"(?<![\w.])(?:\p{{L}}\.){{2,}}(?!\w)|(?<!\w)(?:{title})\.(?=\s|$)|(?<!\w)[aApP]\.[mM]\.?(?!\w)",
        # a word with an apostrophe in it
        "inner_apostrophe": r"[\p{L}\d]+(?:['’′][\p{L}\d]+)+",
        # quotes, sentence marks, or colons and semicolons, as many as there are
        "marks": rf"[{_QUOTE}]+|[{_STOP}]+|[:;]+",
        # dashes (two hyphens or more), bars, tildes, equals signs
        "separator": r"-{2,}|[‒-―~|=]+",
        # notes, stars, suits of cards
        "decoration": r"[★☆♠-♯❤✦]+",
        "hashtag": r"(?<![\w&])#\w+",
        "mention": r"(?<![\w.])[@＠]\w+",
    }


#: Kinds in order of preference where several begin at one place.
PATTERNS = _kinds()
PROTECTED = "(?:" + "|".join(PATTERNS.values()) + ")"
#: Brackets and quotes before the first, and after the last, character of a word.
_LEFT = rf"(?<!\S)(?!</?3)([{_QUOTE}{_OPEN}*]+)(?=[\w#@])"
_RIGHT = rf"(?<=\w)([{_QUOTE}{_CLOSE}*]+)(?=[{_STOP}:;]*(?:\s|$))"


def tweet_tokens(s: Column) -> Column:
    """Tokens of a raw tweet: entities decoded, repetition and white space squeezed."""
    t = squeeze_whitespace(html_unescape(F.regexp_replace(remove_repetition(s), _MARK, "")))
    t = F.regexp_replace(F.regexp_replace(t, _LEFT, "$1 "), _RIGHT, " $1")
    pieces = F.split(F.regexp_replace(t, PROTECTED, f"{_MARK}$0{_MARK}"), _MARK, -1)
    parts = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.array(F.trim(x))).otherwise(F.split(F.trim(x), " ")))
    return F.filter(F.flatten(parts), lambda x: x != "")


def tweet_tokens_lower(s: Column) -> Column:
    return tweet_tokens(F.lower(s))
