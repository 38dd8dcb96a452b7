"""Text clean-up and similarity.

Clean-up is made of built-in expressions. Edit ratios, phonetic codes and ASCII
folding have no built-in; they are Arrow-batched functions and are meant for
distinct values or candidate pairs, not for every row of a table.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed(c: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def normalize_text(c: Column) -> Column:
    """Lower-cased, trimmed, then only letters a-z, digits and blanks."""
    return F.regexp_replace(trimmed(F.lower(c)), r"[^a-z0-9\s]", "")


def remove_punctuation(c: Column) -> Column:
    """All but word characters of any script and blanks goes."""
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def strip_currency(c: Column) -> Column:
    """Digits and points only; a minus sign goes too."""
    return F.regexp_replace(c.cast("string"), r"[^\d.]", "")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\s]", "")


def plain_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\s.,-]", "")


def expand_abbreviations(c: Column, full: dict[str, str]) -> Column:
    """Whole words, in any case, in the order of the mapping: a later entry sees
    what an earlier one wrote."""

    def one(text: Column, short: str) -> Column:
        to = full[short].replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, "(?i)\\b\\Q" + short.replace("\\E", "\\E\\\\E\\Q") + "\\E\\b", to)

    return reduce(one, full, c)


def is_lower(c: Column) -> Column:
    """Has a cased letter and none of them is upper case."""
    return (c == F.lower(c)) & (F.lower(c) != F.upper(c))


def has_punctuation(c: Column) -> Column:
    return c.rlike(r"(?U)[^\w\s]")


def fold_ascii(text: str) -> str:
    """Letters without their marks; what has no ASCII form goes."""
    special = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "’": "'", "–": "-", "—": "-"}
    text = "".join(special.get(ch, ch) for ch in text)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold_ascii(t))


def clean_text(c: Column) -> Column:
    """ASCII, single blanks, no punctuation, trimmed, lower-case; NULL is empty."""
    text = F.regexp_replace(_folded(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return F.lower(trimmed(F.regexp_replace(text, r"[^\w\s]", "")))


# --- similarity, 0 to 100 ---------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bit rows (Hyyro, 2004)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> int:
    """Twice the longest common subsequence over both lengths."""
    return round(100 * 2 * lcs_length(a, b) / (len(a) + len(b))) if a or b else 0


def block_ratio(a: str, b: str) -> int:
    """The same with matching blocks instead of the subsequence."""
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio()) if a or b else 0


def cleaned(text: str | None) -> str:
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def token_set_ratio(a: str | None, b: str | None, ratio=edit_ratio) -> int:
    """The best ratio between the shared words and these with each side's own."""
    x, y = set(cleaned(a).split()), set(cleaned(b).split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(own))}".strip() for own in (x - y, y - x))
    return max(ratio(both, left) if both else 0, ratio(both, right) if both else 0, ratio(left, right))


def token_sort_ratio(a: str | None, b: str | None, ratio=edit_ratio) -> int:
    x, y = (" ".join(sorted(cleaned(t).split())) for t in (a, b))
    return ratio(x, y) if x and y else 0


def partial(a: str, b: str, ratio=edit_ratio) -> int:
    """The best ratio of the shorter text with a stretch of its length in the longer."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0
    starts = {max(0, j - i) for i, j, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if n or i == len(a)}
    return max(ratio(a, b[s : s + len(a)]) for s in starts or {0})


def weighted_ratio(a: str | None, b: str | None, ratio=block_ratio) -> int:
    """The best of several ratios. Texts of like length: whole, word-sorted and
    word-set (both at 0.95). Of unlike length: stretches count 0.9, over eight times
    longer 0.6, and 0.95 of that for word forms."""
    x, y = cleaned(a), cleaned(b)
    if not x or not y:
        return 0
    base, far = ratio(x, y), max(len(x), len(y)) / min(len(x), len(y))
    if far < 1.5:
        return round(max(base, 0.95 * token_sort_ratio(x, y, ratio), 0.95 * token_set_ratio(x, y, ratio)))
    scale = 0.6 if far > 8 else 0.9
    words = (" ".join(sorted(t.split())) for t in (x, y))
    sets = " ".join(sorted(set(x.split()) & set(y.split())))
    return round(max(base, scale * partial(x, y, ratio), 0.95 * scale * partial(*words, ratio), 0.95 * scale * (100 if sets else partial(x, y, ratio))))


@lru_cache(maxsize=100_000)
def phonetic_code(text: str) -> str:
    """The primary Double Metaphone code (Philips, 2000) of the letters of a text."""
    w = re.sub("[^A-Z]", "", fold_ascii(text).upper().replace("Ç", "S"))
    if not w:
        return ""
    n, slav = len(w), bool(re.search("W|K|CZ|WITZ", w))
    out, i = "", 0

    def at(k: int, *options: str) -> bool:
        return k >= 0 and any(w.startswith(o, k) for o in options)

    def vowel(k: int) -> bool:
        return 0 <= k < n and w[k] in "AEIOUY"

    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if w[0] == "X":
        out, i = "S", 1
    while i < n:
        c, step = w[i], 1
        if c in "AEIOUY":
            if i == 0:
                out += "A"
        elif c == "B":
            out += "P"
            step = 2 if at(i + 1, "B") else 1
        elif c == "C":
            if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and not at(i + 2, "I") and (not at(i + 2, "E") or at(i - 2, "BACHER", "MACHER")):
                out, step = out + "K", 2
            elif i == 0 and at(0, "CAESAR"):
                out, step = out + "S", 2
            elif at(i, "CHIA"):
                out, step = out + "K", 2
            elif at(i, "CH"):
                if i > 0 and at(i, "CHAE"):
                    out += "K"
                elif i == 0 and (at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM")) and not at(0, "CHORE"):
                    out += "K"
                elif at(0, "VAN", "VON", "SCH") or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, "T", "S"):
                    out += "K"
                elif (i == 0 or at(i - 1, "A", "O", "U", "E")) and (i + 2 >= n or w[i + 2] in "LRNMBHFVW"):
                    out += "K"
                elif i > 0:
                    out += "K" if at(0, "MC") else "X"
                else:
                    out += "X"
                step = 2
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                out, step = out + "S", 2
            elif at(i + 1, "CIA"):
                out, step = out + "X", 3
            elif at(i, "CC") and not (i == 1 and w[0] == "M"):
                if i + 2 < n and w[i + 2] in "IEH" and not at(i + 2, "HU"):
                    out += "KS" if (i == 1 and w[0] == "A") or at(i - 1, "UCCEE", "UCCES") else "X"
                    step = 3
                else:
                    out, step = out + "K", 2
            elif at(i, "CK", "CG", "CQ"):
                out, step = out + "K", 2
            elif at(i, "CI", "CE", "CY"):
                out, step = out + "S", 2
            else:
                out += "K"
                step = 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                if i + 2 < n and w[i + 2] in "IEY":
                    out, step = out + "J", 3
                else:
                    out, step = out + "TK", 2
            else:
                out += "T"
                step = 2 if at(i, "DT", "DD") else 1
        elif c == "F":
            out += "F"
            step = 2 if at(i + 1, "F") else 1
        elif c == "G":
            if at(i + 1, "H"):
                step = 2
                if i > 0 and not vowel(i - 1):
                    out += "K"
                elif i == 0:
                    out += "J" if at(2, "I") else "K"
                elif (i > 1 and w[i - 2] in "BHD") or (i > 2 and w[i - 3] in "BHD") or (i > 3 and w[i - 4] in "BH"):
                    pass
                elif i > 2 and w[i - 1] == "U" and w[i - 3] in "CGLRT":
                    out += "F"
                elif i > 0 and w[i - 1] != "I":
                    out += "K"
            elif at(i + 1, "N"):
                step = 2
                if i == 1 and vowel(0) and not slav:
                    out += "KN"
                elif not at(i + 2, "EY") and not slav:
                    out += "N"
                else:
                    out += "KN"
            elif at(i + 1, "LI") and not slav:
                out, step = out + "KL", 2
            elif i == 0 and (at(1, "Y") or at(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                out, step = out + "K", 2
            elif at(i + 1, "ER", "Y") and not at(0, "DANGER", "RANGER", "MANGER") and not (i > 0 and w[i - 1] in "EI") and not at(i - 1, "RGY", "OGY"):
                out, step = out + "K", 2
            elif (i + 1 < n and w[i + 1] in "EIY") or at(i - 1, "AGGI", "OGGI"):
                out += "K" if at(0, "VAN", "VON", "SCH") or at(i + 1, "ET") else "J"
                step = 2
            else:
                out += "K"
                step = 2 if at(i + 1, "G") else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                out, step = out + "H", 2
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN"):
                out += "H" if (i == 0 and n == 4) or at(0, "SAN") else "J"
            elif i == 0:
                out += "J"
            elif vowel(i - 1) and not slav and i + 1 < n and w[i + 1] in "AO":
                out += "J"
            elif i == n - 1:
                out += "J"
            elif not (i + 1 < n and w[i + 1] in "LTKSNMBZ") and w[i - 1] not in "SKL":
                out += "J"
            step = 2 if at(i + 1, "J") else 1
        elif c == "K":
            out += "K"
            step = 2 if at(i + 1, "K") else 1
        elif c == "L":
            out += "L"
            step = 2 if at(i + 1, "L") else 1
        elif c == "M":
            out += "M"
            step = 2 if at(i + 1, "M") or (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) else 1
        elif c == "N":
            out += "N"
            step = 2 if at(i + 1, "N") else 1
        elif c == "P":
            if at(i + 1, "H"):
                out, step = out + "F", 2
            else:
                out += "P"
                step = 2 if at(i + 1, "P", "B") else 1
        elif c == "Q":
            out += "K"
            step = 2 if at(i + 1, "Q") else 1
        elif c == "R":
            if not (i == n - 1 and not slav and at(i - 2, "IE") and not at(i - 4, "ME", "MA")):
                out += "R"
            step = 2 if at(i + 1, "R") else 1
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and at(0, "SUGAR"):
                out += "X"
            elif at(i, "SH"):
                out += "S" if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"
                step = 2
            elif at(i, "SIO", "SIA"):
                out, step = out + "S", 3
            elif (i == 0 and n > 1 and w[1] in "MNLW") or at(i + 1, "Z"):
                out += "S"
                step = 2 if at(i + 1, "Z") else 1
            elif at(i, "SC"):
                if at(i + 2, "H"):
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        out += "X" if at(i + 3, "ER", "EN") else "SK"
                    else:
                        out += "X"
                elif i + 2 < n and w[i + 2] in "IEY":
                    out += "S"
                else:
                    out += "SK"
                step = 3
            else:
                if not (i == n - 1 and at(i - 2, "AI", "OI")):
                    out += "S"
                step = 2 if at(i + 1, "S", "Z") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                out, step = out + "X", 3
            elif at(i, "TH", "TTH"):
                out += "T" if at(i + 2, "OM", "AM") or at(0, "VAN", "VON", "SCH") else "0"
                step = 2
            else:
                out += "T"
                step = 2 if at(i + 1, "T", "D") else 1
        elif c == "V":
            out += "F"
            step = 2 if at(i + 1, "V") else 1
        elif c == "W":
            if at(i, "WR"):
                out, step = out + "R", 2
            elif i == 0 and (vowel(1) or at(0, "WH")):
                out += "A"
            elif at(i, "WICZ", "WITZ"):
                out, step = out + "TS", 4
        elif c == "X":
            if not (i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))):
                out += "KS"
            step = 2 if at(i + 1, "C", "X") else 1
        elif c == "Z":
            if at(i + 1, "H"):
                out, step = out + "J", 2
            else:
                out += "S"
                step = 2 if at(i + 1, "Z") else 1
        i += step
    return out


def phonetic_similarity(a: str | None, b: str | None) -> int:
    """Word-set ratio of the phonetic codes; text without letters has none."""
    return token_set_ratio(phonetic_code(a or ""), phonetic_code(b or ""))


def _scorer(function):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}

        def one(pair: tuple) -> float:
            if pair not in known:
                known[pair] = float(function(*pair))
            return known[pair]

        return pd.Series([one(p) for p in zip(a, b, strict=True)], dtype="float64")

    return score


SCORERS = {"token_set": token_set_ratio, "phonetic": phonetic_similarity, "weighted": weighted_ratio, "edit": lambda a, b: edit_ratio(a or "", b or "")}


def similarity(a: Column, b: Column, scorer: str = "token_set") -> Column:
    """0 to 100 by an Arrow-batched scorer: token_set, phonetic, weighted or edit.
    A NULL side counts as empty and gives 0."""
    return _scorer(SCORERS[scorer])(a, b)


def levenshtein_score(a: Column, b: Column) -> Column:
    """100 less the share of characters to change; built in."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def words_of(c: Column) -> Column:
    """Sorted distinct words of the normalised text."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(spaced, " "), lambda w: w != "")))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over all words, 0 to 100; built in. 0 for no words."""
    return list_overlap(words_of(a), words_of(b))


def list_overlap(x: Column, y: Column) -> Column:
    """The same of two lists of distinct words."""
    shared = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - shared
    return F.when(every == 0, 0.0).otherwise(100.0 * shared / every)
