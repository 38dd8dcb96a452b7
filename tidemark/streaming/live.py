"""Checking batches as they arrive, against rules learned from history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import qcol
from tidemark.operators.profile import collect_patterns, collect_profile, compare_history, infer_patterns, profile
from tidemark.operators.repair import mark_issues
from tidemark.operators.rules import INVALID, MISSING, Rule, compile_rules


def learn_rules(history: DataFrame, cols: list[str] | None = None) -> dict[str, Rule]:
    """Format rules for each column of a trusted table."""
    return compile_rules(collect_patterns(infer_patterns(history, cols)))


def mark_stream(stream: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """A stream with MISSING and INVALID cells marked: a projection without state."""
    return mark_issues(stream, rules)


def windowed_issues(marked: DataFrame, cols: list[str], time: str = "ts", window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, column_name, missing, invalid, rows) by event time; rows later than
    ``delay`` behind the newest are left out. Works on a batch too."""
    timed = marked.withColumn(time, qcol(time).cast("timestamp"))
    timed = timed.withWatermark(time, delay)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), qcol(c).cast("string").alias("v")) for c in cols]))
    flat = timed.select(qcol(time).alias("ts"), cells.alias("c")).select("ts", "c.*")
    counts = flat.groupBy(F.window("ts", window).alias("w"), "column_name").agg(
        F.count_if(F.col("v") == MISSING).alias("missing"), F.count_if(F.col("v") == INVALID).alias("invalid"), F.count("*").alias("rows")
    )
    return counts.select(F.col("w.start").alias("start"), "column_name", "missing", "invalid", "rows")


def without_late_duplicates(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """First arrivals by key; a repeat within ``delay`` of it is dropped."""
    timed = stream.withColumn(time, qcol(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def alert_on_drift(history: DataFrame, report: Callable[[DataFrame, int], None], tolerance: float = 0.1) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: gives ``report`` the metrics of each batch that
    leave the bounds of the history's profile."""
    known = collect_profile(profile(history))

    def check(batch: DataFrame, number: int) -> None:
        report(compare_history(profile(batch, [c for c in batch.columns if c in known]), known, tolerance), number)

    return check


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a finite stream gives, as a table: runs it over what has arrived
    and ends. For aggregates of bounded size."""
    import uuid

    name = f"drained_{uuid.uuid4().hex[:12]}"
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)
