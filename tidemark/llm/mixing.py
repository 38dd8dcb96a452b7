"""Mixing sources to target weights by subset-sum budget fitting.

Targets share the budget by weight, none above ``ceiling`` times its source's
size. A source whose target covers its size several times is taken that often
whole; what remains of the budget is a subset-sum problem over whole documents.
It is solved on the histogram of document sizes, not on documents: each size is
first taken in proportion, which keeps the source's make-up, then sizes are
topped up greedily, largest first, and a bounded-knapsack dynamic programme over
bit sets fits the last words exactly where the sizes allow. Which documents stand
for a size's count is decided by a seeded hash.

The histogram has one row for each distinct size of a source, and k distinct
sizes need k * (k - 1) / 2 words, so it grows with the square root of the data at
most. Documents of a size are dealt by hash into groups, more where there are more
rows; whole groups are taken in order and only the one group that is taken in part
is ranked. So a size that very many documents share is never sorted in one task.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import join_unique
from tidemark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GROUP = 100_000  # rows of a group, where all rows have one size
LAST = 1 << 15  # words that the dynamic programme covers


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), ceiling: int = 2) -> dict:
    """Source -> target words. Sources by code point, null last, take the weights
    in turn; a target above ``ceiling`` times its source's size is cut to that and
    the excess goes to the others by weight, until none is above. Exact."""
    order = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: Fraction(ceiling * n) for s, n in order}
    budget = share * sum(n for _, n in order)
    got: dict = {}
    open_ = [s for s, _ in order]
    while open_:
        unit = (budget - sum(got.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > limit[s]]
        if not over:
            got |= {s: unit * weight[s] for s in open_}
            break
        got |= {s: limit[s] for s in over}
        open_ = [s for s in open_ if s not in got]
    return got


def fit_counts(histogram: dict[int, int], budget: int, last: int = LAST) -> dict[int, int]:
    """How many documents of each size to take so that their sizes sum to the
    largest value up to ``budget`` that is reached this way: in proportion, then
    greedily, then by dynamic programming over the last ``last`` words. The greedy
    steps stop with more than ``last`` words left only where each document left is
    larger than the rest, and then nothing more could be taken by any way."""
    sizes = sorted((s for s, c in histogram.items() if s > 0 and c > 0), reverse=True)
    total = sum(s * histogram[s] for s in sizes)
    if budget >= total:
        return {s: histogram[s] for s in sizes}
    taken = {s: histogram[s] * max(budget, 0) // total for s in sizes}
    rest = budget - sum(s * c for s, c in taken.items())
    spare = last // 2  # left for the programme, which needs room to choose
    for s in sizes:
        more = min(histogram[s] - taken[s], max(0, rest - spare) // s)
        taken[s] += more
        rest -= more * s
    for s in sizes:  # nothing small enough was left: the budget comes within reach of the programme again
        if rest <= last:
            break
        more = min(histogram[s] - taken[s], rest // s)
        taken[s] += more
        rest -= more * s
    rest_now = min(rest, last)
    reach, steps, mask = 1, [], (1 << (rest_now + 1)) - 1
    for s in reversed(sizes):
        left, chunk = min(histogram[s] - taken[s], rest_now // s), 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((s, chunk, reach))
            reach |= (reach << (s * chunk)) & mask
            left, chunk = left - chunk, chunk * 2
        if reach >> rest_now:
            break
    at = reach.bit_length() - 1
    for s, chunk, before in reversed(steps):
        if not before >> at & 1:
            taken[s] += chunk
            at -= s * chunk
    return taken


def plan(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), ceiling: int = 2) -> DataFrame:
    """``docs`` (doc_id, source, size) with source_size, target (of the source) and
    times, how often the mix takes the row: 0 to ``ceiling``.

    Defined cases: null and empty texts have size 0 and are never taken; null is a
    source of its own, last in order; a source of size 0 has target 0; equal rows
    rank in any order, which gives equal results; no rows give no rows. The table
    of sources, one row each, is read by the driver for the targets. Rows are read
    several times: ``docs`` should be a stored table. Very long texts only have a
    large size; columns other than the three are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    total = docs.count()
    groups = max(16, -(-total // GROUP))
    rows = docs.select("doc_id", "source", "size", key.alias("key"), F.xxhash64(F.lit(seed), "doc_id", "size").alias("h")).withColumn(
        "g", F.pmod("h", F.lit(groups)).cast("int")
    )
    cells = scratch.stage(rows.groupBy("key", "size", "g").agg(F.count("*").alias("n"), F.first("source").alias("source")), "cells")
    sums = [(None if r.none else r.name, int(r.words)) for r in cells.groupBy("key.none", "key.name").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    want = targets(sums, weights, share, ceiling)
    of = [(s is None, s or "", n, float(want[s]), *_passes(want[s], n)) for s, n in sums]
    table = spark.createDataFrame(of, "none boolean, name string, source_size long, target double, whole int, budget long").select(
        F.struct("none", "name").alias("key"), "source_size", "target", "whole", "budget"
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = fit_counts(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]))
        pdf["take"] = [counts.get(s, 0) for s in pdf["size"].tolist()]
        return pdf[["none", "name", "size", "take"]]

    histogram = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).join(table, "key").select("key.none", "key.name", "size", "n", "budget")
    chosen = (
        histogram.groupBy("none", "name")
        .applyInPandas(solve, "none boolean, name string, size long, take long")
        .select(F.struct("none", "name").alias("key"), "size", "take")
    )
    before = Window.partitionBy("key", "size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    reached = cells.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).join(chosen, ["key", "size"])
    # of a size: the last group that is taken from, how many of its rows, and how many it has
    last = F.max(F.when(F.col("from") < F.col("take"), F.struct("g", (F.col("take") - F.col("from")).alias("quota"), "n")))
    cuts = reached.groupBy("key", "size").agg(last.alias("last"), F.sum("n").alias("n")).select(
        "key", "size", "n", F.coalesce("last.g", F.lit(-1)).alias("last"), F.col("last.quota").alias("quota"), (F.col("last.quota") < F.col("last.n")).alias("partly")
    )
    placed = join_unique(rows, cuts, ["key", "size"], total)
    partly = (F.col("g") == F.col("last")) & F.col("partly")
    rank = Window.partitionBy("key", "size").orderBy("h", "doc_id")  # the rows of one group
    some = placed.where(partly).withColumn("extra", (F.row_number().over(rank) <= F.col("quota")).cast("int"))
    rest = placed.where(~F.coalesce(partly, F.lit(False))).withColumn("extra", (F.col("g") <= F.col("last")).cast("int"))
    return (
        some.unionByName(rest)
        .join(F.broadcast(table), "key")  # one row a source, which the driver has read
        .select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).alias("times"))
    )


def _passes(target: Fraction, size: int) -> tuple[int, int]:
    """Whole passes over a source and the words left to fit."""
    if not size:
        return 0, 0
    whole = int(target // size)
    return whole, int(target - whole * size)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: rows of ``docs`` (doc_id, text, source, ...), each as often
    as it is taken, with the columns of ``docs``. Rows that share doc_id, source
    and size share one decision, made on the first of them."""
    names = docs.columns
    base = Scratch(docs.sparkSession, "mixing").stage(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size").distinct(), "sizes")
    times = plan(base, seed).where("times > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "times")
    full = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size"))
    joined = full.join(times.withColumnRenamed("times", "__times"), same)
    return joined.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
