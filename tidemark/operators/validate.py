"""Finding cells and rows that break rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions.columns import as_text, is_numeric, qcol, text_columns
from tidemark.operators.rules import INVALID, Custom, Format, Rule


def valid_value(c: Column, pattern: str, match: str = "full", blank_ok: bool = False) -> Column:
    """NULL is valid, and empty text where ``blank_ok``."""
    good = c.isNull() | P.matches(c, pattern, match)
    return good | (c == "") if blank_ok else good


def valid_masks(df: DataFrame, patterns: dict[str, str], match: str = "full") -> DataFrame:
    """A boolean column valid_<c> for each pattern; a column that is not there
    raises KeyError."""
    for c in patterns:
        if c not in df.columns:
            raise KeyError(c)
    return df.select("*", *[valid_value(as_text(c), p, match).alias(f"valid_{c}") for c, p in patterns.items()])


def invalid_entries(
    df: DataFrame,
    patterns: dict[str, str],
    row_id: str = "row_id",
    match: str = "full",
    blank_ok: bool = False,
    null_text: str | None = None,
) -> DataFrame:
    """(row_id, column_name, value) of present cells that break their pattern.
    Columns that are not there and patterns that do not compile are skipped; with
    ``null_text`` a NULL is tested as that text."""
    good = {c: p for c, p in patterns.items() if c in df.columns and P.is_valid_regex(p)}

    def cell(c: str) -> Column:
        v = as_text(c) if null_text is None else F.coalesce(as_text(c), F.lit(null_text))
        return F.when(~valid_value(v, good[c], match, blank_ok), F.struct(F.lit(c).alias("column_name"), v.alias("value")))

    if not good:
        return df.select(qcol(row_id).alias("row_id"), F.lit("").alias("column_name"), F.lit("").alias("value")).limit(0)
    bad = F.explode(F.array_compact(F.array(*[cell(c) for c in good]))).alias("e")
    return df.select(qcol(row_id).alias("row_id"), bad).select("row_id", "e.column_name", "e.value")


def invalid_columns(df: DataFrame, patterns: dict[str, str], match: str = "full", blank_ok: bool = False) -> DataFrame:
    """(column_name) of the columns with an invalid cell: one pass, no long form."""
    good = [c for c, p in patterns.items() if c in df.columns and P.is_valid_regex(p)]
    if not good:
        return df.sparkSession.createDataFrame([], "column_name string")
    flags = df.agg(*[F.bool_or(~valid_value(as_text(c), patterns[c], match, blank_ok)).alias(f"b{i}") for i, c in enumerate(good)])
    names = F.explode(F.array_compact(F.array(*[F.when(F.col(f"b{i}"), F.lit(c)) for i, c in enumerate(good)])))
    return flags.select(names.alias("column_name"))


def summarize_invalid(entries: DataFrame) -> DataFrame:
    return entries.groupBy("column_name").agg(F.count("*").alias("n"))


def constraint_violations(df: DataFrame, constraints: dict[str, dict], row_id: str = "row_id") -> DataFrame:
    """(row_id, column_name, value, bound): numbers under min or over max, strictly,
    each bound broken one row; other types unlike mode. NULL breaks nothing."""
    cells = []
    for c, limit in constraints.items():
        if c not in df.columns:
            continue
        v = as_text(c).alias("value")
        tests = [("min", lambda x, b: x < b), ("max", lambda x, b: x > b)] if is_numeric(df, c) else [("mode", lambda x, b: x != b)]
        for bound, broken in tests:
            if limit.get(bound) is not None:
                cells.append(F.when(broken(qcol(c), F.lit(limit[bound])), F.struct(F.lit(c).alias("column_name"), v, F.lit(bound).alias("bound"))))
    if not cells:
        return df.sparkSession.createDataFrame([], "row_id long, column_name string, value string, bound string")
    return df.select(qcol(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*cells))).alias("e")).select("row_id", "e.*")


def rule_violations(df: DataFrame, rules: dict[str, Rule], row_id: str = "row_id") -> DataFrame:
    """(row_id, column_name, issue_type) of present cells that a format rule
    rejects or a custom rule cannot handle."""

    def broken(c: str, rule: Rule) -> Column:
        if isinstance(rule, Format):
            return ~P.matches(as_text(c), rule.pattern, rule.match)
        return rule.function(as_text(c)).isNull() if isinstance(rule, Custom) else F.lit(False)

    cells = [F.when(as_text(c).isNotNull() & broken(c, r), F.lit(c)) for c, r in rules.items() if c in df.columns]
    found = F.explode(F.array_compact(F.array(*cells, F.lit(None).cast("string")))).alias("column_name")
    return df.select(qcol(row_id).alias("row_id"), found).withColumn("issue_type", F.lit(INVALID))


def mask_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.select("*", *[qcol(c).isNull().alias(f"is_missing_{c}") for c in cols or df.columns])


def mask_blank(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL or empty, text columns."""
    return df.select("*", *[(qcol(c).isNull() | (qcol(c) == "")).alias(f"is_blank_{c}") for c in cols or text_columns(df)])


def mask_typos(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Adds is_typo_<c>: the value is not in the reference's vocabulary; NULL never
    is. The plan is a join with the distinct values, broadcast if Spark finds them
    small."""
    known = reference.select(qcol(column).alias("__known")).where("__known is not null").distinct()
    flag = F.col("__known").isNull().alias(f"is_typo_{column}")
    return df.join(known, qcol(column) == F.col("__known"), "left").select(*[qcol(c) for c in df.columns], flag)


def mask_out_of_range(df: DataFrame, column: str, reference: DataFrame | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds is_out_of_range_<c>, strict; bounds not given come from the reference."""
    base = (reference if reference is not None else df).agg(F.min(qcol(column)).alias("__lo"), F.max(qcol(column)).alias("__hi"))
    lo, hi = (F.col("__lo") if low is None else F.lit(low)), (F.col("__hi") if high is None else F.lit(high))
    flag = F.coalesce((qcol(column) < lo) | (qcol(column) > hi), F.lit(False)).alias(f"is_out_of_range_{column}")
    return df.crossJoin(F.broadcast(base)).select(*[qcol(c) for c in df.columns], flag)  # one row


def edge_blanks(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, leading, trailing): does any value begin or end with a space?"""
    cols = cols or text_columns(df)
    flags = df.agg(*[F.coalesce(F.bool_or(f(qcol(c), F.lit(" "))), F.lit(False)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("l", F.startswith), ("t", F.endswith))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l{i}").alias("leading"), F.col(f"t{i}").alias("trailing")) for i, c in enumerate(cols)]))
    return flags.select(rows.alias("r")).select("r.*")


def in_domain(cols: list[str], domain: list, code_only: bool = False) -> Column:
    """All of ``cols`` hold a value of the domain; NULL does not. ``code_only``
    compares what stands before the first blank, so ``33140 - Repair`` is 33140."""
    values = [F.substring_index(as_text(c), " ", 1) if code_only else qcol(c) for c in cols]
    return reduce(lambda a, b: a & b, [F.coalesce(v.isin(domain), F.lit(False)) for v in values])


def close(a: Column, b: Column, threshold: float = 0.02) -> Column:
    """|a - b| within ``threshold`` of the larger magnitude; NULL is not close."""
    return F.coalesce(F.abs(a - b) <= threshold * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(qcol(column) >= threshold)


def of_class(df: DataFrame, value: int, column: str = "record_class") -> DataFrame:
    return df.where(qcol(column) == value)
