"""Rules that become column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import patterns as P

MISSING, INVALID = "MISSING", "INVALID"


@dataclass(frozen=True)
class Format:
    """Present values must match ``pattern``."""

    pattern: str
    match: str = "full"

    def apply(self, text: Column) -> Column:
        return F.when(P.matches(text, self.pattern, self.match), text).otherwise(F.lit(INVALID))


@dataclass(frozen=True)
class Bounds:
    """Numbers are held between ``low`` and ``high``; other text becomes ``mode``
    where there is one."""

    low: float | None = None
    high: float | None = None
    mode: str | None = None

    def apply(self, text: Column) -> Column:
        bare = F.regexp_replace(text, r"[^A-Za-z0-9\s]", "")
        return constrained(bare, self.low, self.high, self.mode)


@dataclass(frozen=True)
class Custom:
    """Any function from a text column to a text column; NULL is INVALID."""

    function: Callable[[Column], Column]

    def apply(self, text: Column) -> Column:
        return F.coalesce(self.function(text).cast("string"), F.lit(INVALID))


Rule = Format | Bounds | Custom


def compile_rules(patterns: dict[str, str], constraints: dict[str, dict] | None = None, match: str = "full") -> dict[str, Rule]:
    """A rule for each column with a pattern. A column with a constraint (min, max,
    mode of its own) gets that one, the others are checked by their pattern. A
    constraint that is no mapping raises TypeError, a pattern that does not compile
    ValueError; constraints of columns without a pattern are left out."""
    out: dict[str, Rule] = {}
    for column, pattern in P.check_patterns(patterns).items():
        limit = (constraints or {}).get(column)
        if limit is not None:
            if not isinstance(limit, dict):
                raise TypeError(f"the constraint of {column} is not a mapping")
            out[column] = Bounds(limit.get("min"), limit.get("max"), limit.get("mode"))
        elif P.is_valid_regex(pattern):
            out[column] = Format(pattern, match)
        else:
            raise ValueError(f"the pattern of {column} does not compile")
    return out


def clip(c: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """``c`` within bounds; NULL stays NULL and a NULL bound is none."""
    lo = F.lit(None) if low is None else low if isinstance(low, Column) else F.lit(low)
    hi = F.lit(None) if high is None else high if isinstance(high, Column) else F.lit(high)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def constrained(text: Column, low: float | None, high: float | None, mode: str | None) -> Column:
    """Text of a number below ``low`` becomes that bound, above ``high`` this one;
    text that is no number and not ``mode`` becomes the mode."""
    number = text.try_cast("double")
    out = text
    if mode is not None:
        out = F.when(number.isNull() & (text != mode), F.lit(str(mode))).otherwise(out)
    if high is not None:
        out = F.when(number > high, F.lit(str(high))).otherwise(out)
    if low is not None:
        out = F.when(number < low, F.lit(str(low))).otherwise(out)
    return out
