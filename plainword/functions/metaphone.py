"""Double Metaphone, primary code (Philips, 2000), four characters at most; an Arrow function over distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LENGTH = 4
_VOWELS = set("AEIOUY")


def double_metaphone(word: str | None, length: int = LENGTH) -> str | None:
    w = (word or "").strip().upper()
    if not w:
        return None
    n, last = len(w), len(w) - 1
    slavo = "W" in w or "K" in w or "CZ" in w or "WITZ" in w
    out: list[str] = []

    def at(i: int, k: int, *options: str) -> bool:
        return 0 <= i and w[i : i + k] in options

    def vowel(i: int) -> bool:
        return 0 <= i < n and w[i] in _VOWELS

    i = 1 if at(0, 2, "GN", "KN", "PN", "WR", "PS") else 0
    while len("".join(out)) < length and i < n:
        c, step, code = w[i], 1, ""
        if c in _VOWELS:
            code = "A" if i == 0 else ""
        elif c == "B":
            code, step = "P", 2 if at(i + 1, 1, "B") else 1
        elif c == "Ç":
            code = "S"
        elif c == "C":
            code, step = _c(w, i, at, vowel)
        elif c == "D":
            if at(i, 2, "DG"):
                code, step = ("J", 3) if at(i + 2, 1, "I", "E", "Y") else ("TK", 2)
            else:
                code, step = "T", 2 if at(i, 2, "DT", "DD") else 1
        elif c == "F":
            code, step = "F", 2 if at(i + 1, 1, "F") else 1
        elif c == "G":
            code, step = _g(w, i, at, vowel, slavo)
        elif c == "H":
            code, step = ("H", 2) if (i == 0 or vowel(i - 1)) and vowel(i + 1) else ("", 1)
        elif c == "J":
            if at(i, 4, "JOSE") or at(0, 4, "SAN "):
                code = "H" if (i == 0 and (n == 4 or at(i + 4, 1, " "))) or n == 4 or at(0, 4, "SAN ") else "J"
            else:
                if i == 0:
                    code = "J"
                elif vowel(i - 1) and not slavo and at(i + 1, 1, "A", "O"):
                    code = "J"
                elif i == last:
                    code = "J"
                elif not at(i + 1, 1, *"LTKSNMBZ") and not at(i - 1, 1, "S", "K", "L"):
                    code = "J"
            step = 2 if at(i + 1, 1, "J") else 1
        elif c == "K":
            code, step = "K", 2 if at(i + 1, 1, "K") else 1
        elif c == "L":
            code, step = "L", 2 if at(i + 1, 1, "L") else 1
        elif c == "M":
            mute = at(i + 1, 1, "M") or (at(i - 1, 3, "UMB") and (i + 1 == last or at(i + 2, 2, "ER")))
            code, step = "M", 2 if mute else 1
        elif c == "N":
            code, step = "N", 2 if at(i + 1, 1, "N") else 1
        elif c == "Ñ":
            code = "N"
        elif c == "P":
            code, step = ("F", 2) if at(i + 1, 1, "H") else ("P", 2 if at(i + 1, 1, "P", "B") else 1)
        elif c == "Q":
            code, step = "K", 2 if at(i + 1, 1, "Q") else 1
        elif c == "R":
            silent = i == last and not slavo and at(i - 2, 2, "IE") and not at(i - 4, 2, "ME", "MA")
            code, step = "" if silent else "R", 2 if at(i + 1, 1, "R") else 1
        elif c == "S":
            code, step = _s(w, i, at, vowel, slavo, last)
        elif c == "T":
            if at(i, 4, "TION") or at(i, 3, "TIA", "TCH"):
                code, step = "X", 3
            elif at(i, 2, "TH") or at(i, 3, "TTH"):
                german = at(i + 2, 2, "OM", "AM") or at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH")
                code, step = "T" if german else "0", 2
            else:
                code, step = "T", 2 if at(i + 1, 1, "T", "D") else 1
        elif c == "V":
            code, step = "F", 2 if at(i + 1, 1, "V") else 1
        elif c == "W":
            if at(i, 2, "WR"):
                code, step = "R", 2
            elif i == 0 and (vowel(1) or at(0, 2, "WH")):
                code = "A"
            elif (i == last and vowel(i - 1)) or at(i - 1, 5, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, 3, "SCH"):
                code = ""
            elif at(i, 4, "WICZ", "WITZ"):
                code, step = "TS", 4
        elif c == "X":
            if i == 0:
                code = "S"
            else:
                french = i == last and (at(i - 3, 3, "IAU", "EAU") or at(i - 2, 2, "AU", "OU"))
                code, step = "" if french else "KS", 2 if at(i + 1, 1, "C", "X") else 1
        elif c == "Z":
            code, step = ("J", 2) if at(i + 1, 1, "H") else ("S", 2 if at(i + 1, 1, "Z") else 1)
        out.append(code)
        i += step
    return "".join(out)[:length]


def _c(w: str, i: int, at, vowel) -> tuple[str, int]:
    if (at(i, 4, "CHIA")) or (i > 1 and not vowel(i - 2) and at(i - 1, 3, "ACH") and ((not at(i + 2, 1, "I") and not at(i + 2, 1, "E")) or at(i - 2, 6, "BACHER", "MACHER"))):
        return "K", 2
    if i == 0 and at(i, 6, "CAESAR"):
        return "S", 2
    if at(i, 2, "CH"):
        if i > 0 and at(i, 4, "CHAE"):
            return "K", 2
        greek = i == 0 and (at(i + 1, 5, "HARAC", "HARIS") or at(i + 1, 3, "HOR", "HYM", "HIA", "HEM")) and not at(0, 5, "CHORE")
        hard = at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i - 2, 6, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, 1, "T", "S")
        hard = hard or ((at(i - 1, 1, "A", "O", "U", "E") or i == 0) and (at(i + 2, 1, *"LRNMBHFVW ") or i + 1 == len(w) - 1))
        if greek or hard:
            return "K", 2
        return ("K" if i > 0 and at(0, 2, "MC") else "X"), 2
    if at(i, 2, "CZ") and not at(i - 2, 4, "WICZ"):
        return "S", 2
    if at(i + 1, 3, "CIA"):
        return "X", 3
    if at(i, 2, "CC") and not (i == 1 and w[0] == "M"):
        if at(i + 2, 1, "I", "E", "H") and not at(i + 2, 2, "HU"):
            return ("KS" if (i == 1 and w[0] == "A") or at(i - 1, 5, "UCCEE", "UCCES") else "X"), 3
        return "K", 2
    if at(i, 2, "CK", "CG", "CQ"):
        return "K", 2
    if at(i, 2, "CI", "CE", "CY"):
        return "S", 2
    if at(i + 1, 2, " C", " Q", " G"):
        return "K", 3
    return "K", 2 if at(i + 1, 1, "C", "K", "Q") and not at(i + 1, 2, "CE", "CI") else 1


def _g(w: str, i: int, at, vowel, slavo: bool) -> tuple[str, int]:
    if at(i + 1, 1, "H"):
        if i > 0 and not vowel(i - 1):
            return "K", 2
        if i == 0:
            return ("J" if at(i + 2, 1, "I") else "K"), 2
        if at(i - 2, 1, "B", "H", "D") or at(i - 3, 1, "B", "H", "D") or at(i - 4, 1, "B", "H"):
            return "", 2
        if i > 2 and w[i - 1] == "U" and at(i - 3, 1, "C", "G", "L", "R", "T"):
            return "F", 2
        return ("K" if i > 0 and w[i - 1] != "I" else ""), 2
    if at(i + 1, 1, "N"):
        if i == 1 and vowel(0) and not slavo:
            return "KN", 2
        return ("N" if not at(i + 2, 2, "EY") and not slavo else "KN"), 2
    if at(i + 1, 2, "LI") and not slavo:
        return "KL", 2
    if i == 0 and (at(1, 1, "Y") or at(1, 2, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", 2
    if (at(i + 1, 2, "ER") or at(i + 1, 1, "Y")) and not at(0, 6, "DANGER", "RANGER", "MANGER") and not at(i - 1, 1, "E", "I") and not at(i - 1, 3, "RGY", "OGY"):
        return "K", 2
    if at(i + 1, 1, "E", "I", "Y") or at(i - 1, 4, "AGGI", "OGGI"):
        german = at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i + 1, 2, "ET")
        return ("K" if german else "J"), 2
    return "K", 2 if at(i + 1, 1, "G") else 1


def _s(w: str, i: int, at, vowel, slavo: bool, last: int) -> tuple[str, int]:
    if at(i - 1, 3, "ISL", "YSL"):
        return "", 1
    if i == 0 and at(i, 5, "SUGAR"):
        return "X", 1
    if at(i, 2, "SH"):
        return ("S" if at(i + 1, 4, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
    if at(i, 3, "SIO", "SIA") or at(i, 4, "SIAN"):
        return "S", 3
    if (i == 0 and at(i + 1, 1, "M", "N", "L", "W")) or at(i + 1, 1, "Z"):
        return "S", 2 if at(i + 1, 1, "Z") else 1
    if at(i, 2, "SC"):
        if at(i + 2, 1, "H"):
            if at(i + 3, 2, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X" if at(i + 3, 2, "ER", "EN") else "SK"), 3
            return "X", 3
        return ("S" if at(i + 2, 1, "I", "E", "Y") else "SK"), 3
    french = i == last and at(i - 2, 2, "AI", "OI")
    return ("" if french else "S"), 2 if at(i + 1, 1, "S", "Z") else 1


@F.pandas_udf(StringType())
def primary_code(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(double_metaphone)
