"""Synthetic rows from a profile and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What stands for a pattern, by the exact text of the pattern.
WORDS = ("Example", "Test", "Synthetic")
CODES = ("Data123", "Sample45", "Synthetic")
POSTCODES = ("EC1A 1BB", "W1A 0AX", "M1 1AE")
ADDRESSES = ("123 Main St.", "Unit 45, Example Rd", "Synthetic Value")
FALLBACK = "SyntheticValue"


def _between(low: int, high: int, seed: int) -> Column:
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def _one_of(options: tuple[str, ...], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _between(1, len(options), seed))


def value_for_pattern(pattern: str, seed: int = 42) -> Column:
    """A random value of a known pattern, drawn anew in each row."""
    makers = {
        r"^\d+$": lambda: _between(1000, 9999, seed).cast("string"),
        r"^\d+\.\d+$": lambda: F.format_string("%d.%02d", _between(1, 1000, seed), _between(0, 99, seed + 1)),
        r"^\d{4}-\d{2}-\d{2}$": lambda: F.format_string("%d-%02d-%02d", _between(2000, 2023, seed), _between(1, 12, seed + 1), _between(1, 28, seed + 2)),
        r"^[A-Za-z\s]+$": lambda: _one_of(WORDS, seed),
        r"^[A-Za-z0-9\s]+$": lambda: _one_of(CODES, seed),
        r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$": lambda: _one_of(POSTCODES, seed),
        r"^[A-Za-z0-9\s,.\-]+$": lambda: _one_of(ADDRESSES, seed),
    }
    return makers[pattern]() if pattern in makers else F.lit(FALLBACK)


def synthesize(spark: SparkSession, metrics: dict[str, dict], patterns: dict[str, str], n: int = 100, seed: int = 42, digits: int | None = 2) -> DataFrame:
    """``n`` rows: normal draws for columns with mean and std, the mode where there
    is one, else NULL; then columns that only have a pattern. Draws follow the seed
    and the row's partition."""
    cols = []
    for i, (name, m) in enumerate(metrics.items()):
        if m.get("mean") is not None and m.get("std") is not None:
            value = F.lit(float(m["mean"])) + F.lit(float(m["std"])) * F.randn(seed + i)
            cols.append((F.bround(value, digits) if digits is not None else value).alias(name))
        else:
            cols.append(F.lit(m.get("mode")).cast("string").alias(name))
    for i, (name, p) in enumerate((c, p) for c, p in patterns.items() if c not in metrics):
        cols.append(value_for_pattern(p, seed + 100 + 3 * i).alias(name))
    return spark.range(n).select(*cols)


def clamp(c: Column, limit: dict) -> Column:
    """A number within the min and max of a constraint; other types as they are."""
    from tidemark.operators.rules import clip

    return clip(c, limit.get("min"), limit.get("max"))
