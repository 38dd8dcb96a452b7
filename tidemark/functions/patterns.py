"""Formats as regular expressions: classes of values, matching, rule catalogue."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = ".*"

# The classes of a value's format, in order of trial; (test, what is
# emitted). The first set is used by the profiler, the second by history checks.
RULESET_1 = (
    (r"^\d+$", r"^\d+$"),
    (r"^\d+\.\d+$", r"^\d+\.\d+$"),
    (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"),
    (r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}$"),
    (r"^\d{2}:\d{2}(:\d{2})?$", r"^\d{2}:\d{2}(:\d{2})?$"),
    (r"^[A-Za-z\s]+$", r"^[A-Za-z\s]+$"),
    (r"^[A-Za-z0-9\s]+$", r"^[A-Za-z0-9\s]+$"),
    (r"^[A-Za-z0-9\s,.\-]+$", r"^[A-Za-z0-9\s,.\-]+$"),
    (r"^[\w\-_]+$", r"^[\w\-_]+$"),
    (r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$", r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$"),
)
RULESET_2 = (
    (r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$", r"[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}"),
    (r"^\d{2}/\d{2}/\d{4}$", r"\d{2}/\d{2}/\d{4}"),
    (r"^http://business\.data\.gov\.uk/id/company/[A-Z0-9]+$", r"http://business\.data\.gov\.uk/id/company/[A-Z0-9]+"),
    (r"^[A-Za-z\s,]+$", r"[A-Za-z\s,]+"),
    (r"^[A-Za-z\s\-\/]+(?: [A-Za-z\s\-\/]+)*$", r"[A-Za-z\s\-\/]+(?: [A-Za-z\s\-\/]+)*"),
    (r"^[A-Za-z0-9/\s\-,()'\"]+$", r"[A-Za-z0-9/\s\-,()'\"]+"),
    (r"^[A-Za-z0-9\s]+$", r"[A-Za-z0-9\s]+"),
    (r"^[^A-Za-z0-9\s\-()]+$", r"[^A-Za-z0-9\s\-()]+"),
)
RULESETS = {1: RULESET_1, 2: RULESET_2}

# The format rules of a company register, kind of value and columns.
_WORDS = r"^[^\s][A-Za-z0-9\s]*[^\s]$"
_DAY = r"^[^\s]\d{2}/\d{2}/\d{4}[^\s]$"
_DAY_OR_NONE = r"^(?:[^\s]\d{2}/\d{2}/\d{4}[^\s])?$"
COMPANY_RULES = {
    "CompanyName": r"^[^\s][A-Za-z0-9\s\-()]*[^\s]$",
    "CompanyNumber": _WORDS,
    "RegAddress.CareOf": _WORDS,
    "RegAddress.POBox": _WORDS,
    "RegAddress.AddressLine1": _WORDS,
    "RegAddress.AddressLine2": _WORDS,
    "RegAddress.PostTown": _WORDS,
    "RegAddress.County": _WORDS,
    "RegAddress.Country": _WORDS,
    "RegAddress.PostCode": r"^[^\s][A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}[^\s]$",
    "CompanyCategory": r"^[^\s][A-Za-z0-9/\s\-,()']*[^\s]$",
    "CompanyStatus": r"^[^\s][A-Za-z\s\-\/]+(?: [A-Za-z\s\-\/]+)*[^\s]$",
    "CountryOfOrigin": r"^[^\s][A-Za-z\s,]*[^\s]$",
    "DissolutionDate": _DAY_OR_NONE,
    "IncorporationDate": _DAY,
    "Accounts.AccountRefDay": _WORDS,
    "Accounts.AccountRefMonth": _WORDS,
    "Accounts.NextDueDate": _DAY,
    "Accounts.LastMadeUpDate": _DAY,
    "Accounts.AccountCategory": _WORDS,
    "Returns.NextDueDate": _DAY,
    "Returns.LastMadeUpDate": _DAY,
    "Mortgages.NumMortCharges": _WORDS,
    "Mortgages.NumMortOutstanding": _WORDS,
    "Mortgages.NumMortPartSatisfied": _WORDS,
    "Mortgages.NumMortSatisfied": _WORDS,
    "SICCode.SicText_1": _WORDS,
    "SICCode.SicText_2": _WORDS,
    "SICCode.SicText_3": _WORDS,
    "SICCode.SicText_4": _WORDS,
    "LimitedPartnerships.NumGenPartners": _WORDS,
    "LimitedPartnerships.NumLimPartners": _WORDS,
    "URI": r"^http://business\.data\.gov\.uk/id/company/[A-Z0-9]+$",
    **{f"PreviousName_{i}.{part}": rule for i in range(1, 11) for part, rule in (("CONDATE", _DAY), ("CompanyName", _WORDS))},
    "ConfStmtNextDueDate": _DAY_OR_NONE,
}


def corrected_company_rules() -> dict[str, str]:
    """The same rules without the extra character that the originals demand at
    both ends: first and last character must not be blank, nothing more."""
    out = {}
    for column, rule in COMPANY_RULES.items():
        body = rule.replace("[^\\s]", "")
        out[column] = r"^(?!\s)(?:" + body.removeprefix("^").removesuffix("$") + r")(?<!\s)$" if body != rule else rule
    return out


def to_java(pattern: str) -> str:
    """A Python pattern in Java's dialect."""
    return re.sub(r"\(\?P<([^>]+)>", r"(?<\1>", pattern).replace(r"\Z", r"\z")


def full(pattern: str, unicode: bool = False) -> str:
    """Matches whole values only; a line feed at the end is part of the value."""
    return ("(?U)" if unicode else "") + rf"\A(?:{_closed(to_java(pattern))})\z"


def prefix(pattern: str, unicode: bool = False) -> str:
    """Matches at the start of a value."""
    return ("(?U)" if unicode else "") + rf"\A(?:{to_java(pattern)})"


def _closed(pattern: str) -> str:
    """``$`` at the end means the end of the value, not the place before a last line feed."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern


def matches(c: Column, pattern: str, match: str = "full", unicode: bool = False) -> Column:
    if match not in ("full", "prefix"):
        raise ValueError(f"match is full or prefix, not {match}")
    return c.rlike((full if match == "full" else prefix)(pattern, unicode))


def is_valid_regex(pattern: object) -> bool:
    if isinstance(pattern, re.Pattern):
        return True
    try:
        re.compile(pattern)  # type: ignore[arg-type]
    except (re.error, TypeError):
        return False
    return True


def check_patterns(patterns: dict) -> dict[str, str]:
    """Patterns as text; a value that is no pattern raises TypeError."""
    out = {}
    for column, p in patterns.items():
        if not isinstance(p, str | re.Pattern):
            raise TypeError(f"the pattern of {column} is neither text nor compiled")
        out[column] = p.pattern if isinstance(p, re.Pattern) else p
    return out


def combine(patterns: list[str]) -> str:
    """One pattern that accepts what any of them does; invalid ones are left out."""
    good = sorted({p for p in patterns if is_valid_regex(p)})
    if not good:
        return ANY
    return good[0] if len(good) == 1 else "(" + "|".join(good) + ")"


def value_class(c: Column, ruleset: int = 1) -> Column:
    """The pattern of the first class that a text value belongs to, else ``.*``."""
    rules = RULESETS[ruleset]
    first = F.when(matches(c, rules[0][0]), F.lit(rules[0][1]))
    return reduce(lambda w, r: w.when(matches(c, r[0]), F.lit(r[1])), rules[1:], first).otherwise(F.lit(ANY))
