"""Joins that a few very frequent keys do not hold up.

Adaptive execution splits a skewed side only where both sides are plain
exchanges. These joins do not rely on it: keys over a share of all rows are few
by arithmetic, so a table of them can be broadcast, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 50_000  # rows of a broadcast table of hot keys
LEAST = 10_000  # rows of a key that one task may well take


def hot_limit(total: int, least: int = LEAST) -> int:
    """Of counts that sum to ``total``, at most ``MOST_HOT`` are above this."""
    return max(least, total // MOST_HOT)


def join_unique(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, count: str = "n", least: int = LEAST) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key; its column ``count``
    has the number of ``rows`` of the key, ``total`` in all. Hot keys meet their row
    by broadcast and are not shuffled, the others by a shuffle. ``rows`` is read
    twice where hot keys are possible, so it should be a stored table or cheap."""
    key = [key] if isinstance(key, str) else key
    limit = hot_limit(total, least)
    if total <= limit:
        return rows.join(table, key)
    hot = table.where(F.col(count) > limit)  # at most MOST_HOT rows
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(table.where(F.col(count) <= limit), key))
