"""Profiles: completeness, uniqueness, entropy, mode, spread, patterns, duplicates."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions.columns import as_text, is_numeric, numeric_columns, qcol, text_columns
from tidemark.sources.shared import write_text
from tidemark.sources.tables import with_row_id


def long_form(df: DataFrame, cols: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """(ids..., column_name, value): one row a cell, values as text."""
    chosen = [c for c in (cols or df.columns) if c not in (ids or [])]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(c).alias("value")) for c in chosen])).alias("__cell")
    return df.select(*[qcol(i) for i in ids or []], cells).select(*[qcol(i) for i in ids or []], "__cell.column_name", "__cell.value")


def value_counts(df: DataFrame, cols: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """(column_name, value, n) of present values; with ``normalize`` also share."""
    out = long_form(df, cols).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    if not normalize:
        return out
    total = out.groupBy("column_name").agg(F.sum("n").alias("__t"))
    return out.join(total, "column_name").select("column_name", "value", "n", (F.col("n") / F.col("__t")).alias("share"))


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row a column: is_numeric, mean and std (sample) of numbers, mode
    (smallest of the most frequent) and entropy (natural log) of other types,
    unique_ratio and completeness_ratio.

    One pass for the means, and one unpivoted count of values for everything else,
    whatever the number of columns. An empty table has unique_ratio 0 and NULL
    completeness."""
    cols = cols or df.columns
    numbers = [c for c in cols if is_numeric(df, c)]
    counts = value_counts(df, cols)
    per = (
        counts.groupBy("column_name")
        .agg(
            F.count("*").alias("d"),
            F.sum("n").alias("present"),
            F.sum(F.col("n") * F.log("n")).alias("nln"),
            F.min(F.struct((-F.col("n")).alias("c"), "value")).alias("top"),
        )
        .select("column_name", "d", "present", (F.log("present") - F.col("nln") / F.col("present")).alias("entropy"), F.col("top.value").alias("mode"))
    )
    stats = df.agg(
        F.count("*").alias("rows"),
        *[f(qcol(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_samp))],
    )
    at = {c: i for i, c in enumerate(numbers)}
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(c in at).alias("is_numeric"),
                    (F.col(f"m{at[c]}") if c in at else F.lit(None).cast("double")).alias("mean"),
                    (F.col(f"s{at[c]}") if c in at else F.lit(None).cast("double")).alias("std"),
                )
                for c in cols
            ]
        )
    )
    base = stats.select("rows", each.alias("e")).select("rows", "e.*")
    text = ~F.col("is_numeric")
    return base.join(per, "column_name", "left").select(
        "column_name",
        "is_numeric",
        "mean",
        "std",
        F.when(text, F.col("mode")).alias("mode"),
        F.when(text, F.coalesce("entropy", F.lit(0.0))).alias("entropy"),
        F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.coalesce("d", F.lit(0)) / F.col("rows")).alias("unique_ratio"),
        F.when(F.col("rows") > 0, F.coalesce("present", F.lit(0)) / F.col("rows")).alias("completeness_ratio"),
    )


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the columns mode0, mode1, ...: the most frequent present value
    of each of ``cols``, the smallest of equals, in its own type; NULL without
    values. Values are counted by a shuffle on (column, value), with partial counts
    before it, so no buffer holds the distinct values of a column."""
    number = {c: is_numeric(df, c) for c in cols}
    size = F.when(F.col("column_name").isin(*[c for c in cols if number[c]] or [""]), F.col("value").try_cast("double"))
    best = value_counts(df, cols).groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("c"), size.alias("size"), "value")).alias("top"))
    pick = [F.max(F.when(F.col("column_name") == c, F.col("top.value"))).cast(df.schema[c].dataType).alias(f"mode{i}") for i, c in enumerate(cols)]
    return best.agg(*pick)


def quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), gathered: int = 50_000) -> dict[str, list[float | None]]:
    """Exact, interpolated quantiles of number columns; NaN counts as missing, and a
    column without values has None.

    A sketch of bounded size brackets each wanted rank; one pass counts what lies
    below and inside the brackets; brackets of more than ``gathered`` rows are
    narrowed by a sketch of their inside, the others' values are read. So a pass
    holds sketches and counters only, whatever the number of distinct values."""
    error, accuracy = 2e-4, 10_000
    x = {c: F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")) for c in cols}
    near = lambda v, q: F.percentile_approx(v, F.array(F.lit(max(0.0, q - error)), F.lit(min(1.0, q + error))), accuracy)
    first = df.agg(
        *[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))],
        *[near(x[c], q).alias(f"q{i}_{j}") for i, c in enumerate(cols) for j, q in enumerate(shares)],
    ).first()
    ranks: dict[tuple[str, int], float | None] = {}
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(cols):
        for j, q in enumerate(shares):
            at = (first[f"n{i}"] - 1) * q
            for r in {int(at), -int(-at // 1)} if first[f"n{i}"] else ():
                brackets[c, r] = tuple(first[f"q{i}_{j}"])
    ends = {c: (first[f"lo{i}"], first[f"hi{i}"]) for i, c in enumerate(cols)}
    while brackets:
        open_ = list(brackets.items())
        seen = df.agg(
            *[
                F.count_if(test).alias(f"{n}{k}")
                for k, ((c, _), (lo, hi)) in enumerate(open_)
                for n, test in (("a", x[c] < lo), ("b", x[c] == lo), ("m", (x[c] > lo) & (x[c] < hi)), ("z", x[c] == hi))
            ]
        ).first()
        inside, narrow = {}, {}
        for k, ((c, r), (lo, hi)) in enumerate(open_):
            below, upto, middle = seen[f"a{k}"], seen[f"a{k}"] + seen[f"b{k}"], seen[f"m{k}"]
            del brackets[c, r]
            if r < below:
                brackets[c, r] = (ends[c][0], lo)
            elif r < upto:
                ranks[c, r] = lo
            elif r < upto + middle:
                (inside if middle <= gathered else narrow)[c, r] = (lo, hi, r - upto, middle)
            elif r < upto + middle + seen[f"z{k}"]:
                ranks[c, r] = hi
            else:
                brackets[c, r] = (hi, ends[c][1])
        if narrow:
            wanted = list(narrow.items())
            finer = df.agg(*[near(F.when((x[c] > lo) & (x[c] < hi), x[c]), at / n).alias(f"q{k}") for k, ((c, _), (lo, hi, at, n)) in enumerate(wanted)]).first()
            brackets |= {key: tuple(finer[f"q{k}"]) for k, (key, _) in enumerate(wanted)}
        if inside:
            wanted = list(inside.items())
            cells = F.explode(F.array_compact(F.array(*[F.when((x[c] > lo) & (x[c] < hi), F.struct(F.lit(k).alias("k"), x[c].alias("v"))) for k, ((c, _), (lo, hi, _, _)) in enumerate(wanted)])))
            values = df.select(cells.alias("e")).groupBy("e.k", "e.v").count().orderBy("k", "v").collect()  # at most ``gathered`` values a rank
            for k, (key, (_, _, at, _)) in enumerate(wanted):
                for r in (r for r in values if r.k == k):
                    if at < r["count"]:
                        ranks[key] = r.v
                        break
                    at -= r["count"]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for q in shares:
            at = (first[f"n{i}"] - 1) * q
            low, high = int(at), -int(-at // 1)
            if not first[f"n{i}"]:
                out[c].append(None)
            else:
                out[c].append(ranks[c, low] if low == high else (high - at) * ranks[c, low] + (at - low) * ranks[c, high])
    return out


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, count, mean, std, min, q25, q50, q75, max), quartiles exact
    and interpolated."""
    cols = cols or numeric_columns(df)
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    stats = df.agg(*[f(qcol(c).cast("double")).cast("double").alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in parts.items()])
    found = quantiles(df, cols)
    quart = {f"{n}{i}": F.lit(v).cast("double") for i, c in enumerate(cols) for n, v in zip(("q25", "q50", "q75"), found[c], strict=True)}
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[quart.get(f"{n}{i}", F.col(f"{n}{i}")).alias(n) for n in names]) for i, c in enumerate(cols)]))
    return stats.select(rows.alias("r")).select("r.*")


def correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair of number columns, over rows where both are present."""
    cols = sorted(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    stats = df.agg(*[F.corr(qcol(a).cast("double"), qcol(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return stats.select(rows.alias("x")).select("x.*")


def _per_column(df: DataFrame, cols: list[str], **measures) -> DataFrame:
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in measures.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{i}").alias(n) for n in measures]) for i, c in enumerate(cols)]))
    return stats.select(rows.alias("x")).select("x.*")


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, missing, blank): NULL or empty text; NULL or blank after trim."""
    return _per_column(
        df,
        cols or df.columns,
        missing=lambda c: F.count_if(qcol(c).isNull() | (as_text(c) == "")),
        blank=lambda c: F.count_if(qcol(c).isNull() | (F.trim(as_text(c)) == "")),
    )


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, distinct) of present values, exact, by one unpivoted count."""
    cols = cols or df.columns
    some = value_counts(df, cols).groupBy("column_name").agg(F.count("*").alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(some, "column_name", "left").select("column_name", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def ranges(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, low, high) of number columns, missing values apart."""
    return _per_column(df, cols or numeric_columns(df), low=lambda c: F.min(qcol(c).cast("double")), high=lambda c: F.max(qcol(c).cast("double")))


def summary(df: DataFrame) -> DataFrame:
    """(column_name, type, rows, missing_percent); columns and rows of the table."""
    types = dict(df.dtypes)
    out = _per_column(df, df.columns, rows=lambda c: F.count("*"), missing_percent=lambda c: 100 * F.avg(qcol(c).isNull().cast("int")))
    kinds = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return out.select("column_name", kinds[F.col("column_name")].alias("type"), "rows", "missing_percent")


def type_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return out


def duplicate_rows(df: DataFrame, row_id: str, cols: list[str] | None = None) -> DataFrame:
    """The rows that repeat an earlier one in all of ``cols``; NULL equals NULL.
    The first of each group is found by a map-side minimum, not by sorting the
    group, so a value shared by very many rows is no burden."""
    cols = cols or [c for c in df.columns if c != row_id]
    first = df.groupBy(*[qcol(c) for c in cols]).agg(F.min(qcol(row_id)).alias("__first"))
    return df.join(first.select(F.col("__first").alias(row_id)), row_id, "left_anti")


def duplicate_values(df: DataFrame, row_id: str, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, n) within the duplicate rows."""
    cols = cols or [c for c in df.columns if c != row_id]
    return value_counts(duplicate_rows(df, row_id, cols), cols)


def infer_patterns(df: DataFrame, cols: list[str] | None = None, sample_size: int | None = None, ruleset: int = 1, seed: int = 42) -> DataFrame:
    """(column_name, pattern) that every present value of a column matches: its
    values' format classes combined; ``.*`` where there are no values. All rows are
    used; ``sample_size`` draws that many present values of a column instead, by a
    seeded hash of the rows' order, so a stored table gives the same draw each time.
    Set 1 joins several classes in a group, set 2 by bars without anchors."""
    cols = cols or df.columns
    if sample_size is None:
        cells = long_form(df, cols).where("value is not null")
    else:
        numbered = long_form(with_row_id(df.select(*[qcol(c) for c in cols]), name="__row"), cols, ["__row"]).where("value is not null")
        order = Window.partitionBy("column_name").orderBy(F.xxhash64(F.lit(seed), "__row"), "__row")
        cells = numbered.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= sample_size)
    classes = cells.select("column_name", P.value_class(F.col("value"), ruleset).alias("p"))
    found = classes.groupBy("column_name").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    joined = F.array_join("ps", "|")
    several = F.concat(F.lit("("), joined, F.lit(")")) if ruleset == 1 else joined
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    pattern = F.when(F.col("ps").isNull(), F.lit(P.ANY)).when(F.size("ps") == 1, F.col("ps")[0]).otherwise(several)
    return names.join(found, "column_name", "left").select("column_name", pattern.alias("pattern"))


def collect_patterns(found: DataFrame) -> dict[str, str]:
    return {r.column_name: r.pattern for r in found.collect()}  # one row a column


def collect_profile(found: DataFrame) -> dict[str, dict]:
    """Column -> its metrics, in the two shapes of numbers and other types."""
    out = {}
    for r in found.collect():  # one row a column
        names = ("mean", "std") if r.is_numeric else ("mode", "entropy")
        out[r.column_name] = {n: r[n] for n in (*names, "unique_ratio", "completeness_ratio")}
    return out


def save_history(path: str, patterns: dict[str, str], metrics: dict[str, dict], spark: SparkSession | None = None) -> None:
    """Patterns and metrics as one JSON document, the history later checks read;
    with a session, in any store that Spark reaches."""
    write_text(path, json.dumps({"patterns": patterns, "metrics": metrics}, indent=2, sort_keys=True), spark)


def valid_percentages(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(column_name, valid_percentage): share of present values that match."""
    return _per_column(
        df, [c for c in patterns if c in df.columns], valid_percentage=lambda c: 100 * F.avg(P.matches(as_text(c), patterns[c]).cast("int"))
    )


def suggest_constraints(metrics: dict[str, dict], tolerance: float = 0.1) -> dict[str, dict]:
    """Each numeric metric with bounds ``tolerance`` to both sides, the smaller
    first whatever the sign; other metrics as they are."""
    out: dict[str, dict] = {}
    for column, values in metrics.items():
        out[column] = {}
        for name, v in values.items():
            if isinstance(v, int | float) and not isinstance(v, bool):
                low, high = sorted((v * (1 - tolerance), v * (1 + tolerance)))
                out[column][name] = {"min": low, "max": high}
            else:
                out[column][name] = v
    return out


def compare_history(current: DataFrame, history: dict[str, dict], tolerance: float = 0.1) -> DataFrame:
    """(column_name, metric, value, low, high) where a profile leaves the bounds
    that its history suggests."""
    bounds = suggest_constraints(history, tolerance)
    rows = [(c, m, float(b["min"]), float(b["max"])) for c, ms in bounds.items() for m, b in ms.items() if isinstance(b, dict)]
    limits = current.sparkSession.createDataFrame(rows, "column_name string, metric string, low double, high double")
    names = ("mean", "std", "entropy", "unique_ratio", "completeness_ratio")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    now = current.select("column_name", cells.alias("m")).select("column_name", "m.metric", "m.value")
    return now.join(limits, ["column_name", "metric"]).where("value < low or value > high").select("column_name", "metric", "value", "low", "high")


def majority_shares(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, lower_share, punctuation_share) over present text values."""
    from tidemark.functions.text import has_punctuation, is_lower

    return _per_column(
        df,
        cols or text_columns(df),
        lower_share=lambda c: F.avg(is_lower(qcol(c)).cast("int")),
        punctuation_share=lambda c: F.avg(has_punctuation(qcol(c)).cast("int")),
    )


def first_rows_format(df: DataFrame, row_id: str, cols: list[str], n: int = 20) -> DataFrame:
    """(column_name, all_lower, none_punctuated) of the first ``n`` rows; true where
    there are none."""
    from tidemark.functions.text import has_punctuation, is_lower

    return _per_column(
        df.orderBy(row_id).limit(n),
        cols,
        all_lower=lambda c: F.coalesce(F.bool_and(is_lower(qcol(c))), F.lit(True)),
        none_punctuated=lambda c: F.coalesce(F.bool_and(~has_punctuation(qcol(c))), F.lit(True)),
    )
