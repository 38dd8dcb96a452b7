"""Marking and repairing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions.columns import as_text, column_types, is_numeric, qcol, text_columns
from tidemark.functions.text import levenshtein_score, plain_punctuation, similarity
from tidemark.operators.profile import modes, quantiles
from tidemark.operators.rules import INVALID, MISSING, Rule, clip

DEFAULT_STRATEGY = "mean"
VOCABULARY_BLOCK = 20_000


def mark_issues(df: DataFrame, rules: dict[str, Rule], blank_is_missing: bool = True) -> DataFrame:
    """The table with MISSING in cells without a value, INVALID in cells their rule
    rejects, and what a rule made of the others. Columns with a rule become text;
    the others stay. One projection, no shuffle."""

    def cell(c: str) -> Column:
        text = as_text(c)
        absent = text.isNull() | (text == "") if blank_is_missing else text.isNull()
        return F.when(absent, F.lit(MISSING)).otherwise(rules[c].apply(text)).alias(c)

    return df.select(*[cell(c) if c in rules else qcol(c) for c in df.columns])


def issue_counts(marked: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, missing, invalid, issues) over a marked table."""
    cols = cols or text_columns(marked)
    stats = marked.agg(*[F.count_if(qcol(c) == word).alias(f"{n}{i}") for i, c in enumerate(cols) for n, word in (("m", MISSING), ("v", INVALID))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), F.col(f"v{i}").alias("invalid")) for i, c in enumerate(cols)]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.col("r.missing") + F.col("r.invalid")).alias("issues"))


def issue_table(marked: DataFrame, original: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """(row_id, column_name, value, issue_type): one row a marked cell."""
    cells = [F.when(qcol(c).isin(MISSING, INVALID), F.struct(F.lit(c).alias("column_name"), qcol(c).alias("issue_type"))) for c in cols]
    found = marked.select(qcol(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*cells))).alias("e")).select("row_id", "e.*")
    values = F.create_map(*[x for c in cols for x in (F.lit(c), as_text(c))])
    return found.join(original.select(qcol(row_id).alias("row_id"), values.alias("__v")), "row_id").select(
        "row_id", "column_name", F.col("__v")[F.col("column_name")].alias("value"), "issue_type"
    )


def mark_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """MISSING for NULL and empty text."""
    chosen = set(cols or text_columns(df))
    return df.select(*[F.when(qcol(c).isNull() | (qcol(c) == ""), F.lit(MISSING)).otherwise(qcol(c)).alias(c) if c in chosen else qcol(c) for c in df.columns])


def clean_by_pattern(df: DataFrame, patterns: dict[str, str], match: str = "prefix") -> DataFrame:
    """Text that breaks its pattern keeps letters, digits, blanks and ``.,-`` only;
    NULL and empty text stay."""

    def cell(c: str) -> Column:
        v = qcol(c)
        good = v.isNull() | (v == "") | P.matches(v, patterns[c], match)
        return F.when(good, v).otherwise(plain_punctuation(v)).alias(c)

    texts = set(text_columns(df))
    return df.select(*[cell(c) if c in patterns and c in texts else qcol(c) for c in df.columns])


def mark_invalid(df: DataFrame, patterns: dict[str, str], match: str = "prefix") -> DataFrame:
    """INVALID for present, non-empty text that breaks its pattern."""
    return df.select(
        *[
            F.when((qcol(c) != "") & ~P.matches(as_text(c), patterns[c], match), F.lit(INVALID)).otherwise(as_text(c)).alias(c) if c in patterns else qcol(c)
            for c in df.columns
        ]
    )


def impute(df: DataFrame, reference: DataFrame | None = None, strategy: str = DEFAULT_STRATEGY, cols: list[str] | None = None) -> DataFrame:
    """Missing numbers become the reference's mean, median or mode, other missing
    values its mode; columns without a value to take are left as they are. A
    reference without rows gives text the value ``missing``. The mode is the
    smallest of the most frequent values."""
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"strategy is mean, median or mode, not {strategy}")
    ref = df if reference is None else reference
    chosen = [c for c in cols or df.columns if c in ref.columns]
    if not chosen:
        return df
    numbers = [c for c in chosen if is_numeric(df, c) and strategy != "mode"]
    others = [c for c in chosen if c not in numbers]
    stats = ref.agg(F.count("*").alias("__rows"), *[F.avg(qcol(c).cast("double")).alias(f"__mean{i}") for i, c in enumerate(numbers)])
    value = {c: F.col(f"__mean{i}") for i, c in enumerate(numbers)}
    if strategy == "median" and numbers:
        value = {c: F.lit(v[0]).cast("double") for c, v in quantiles(ref, numbers, (0.5,)).items()}
    if others:
        stats = stats.crossJoin(modes(ref, others))  # one row each
        value |= {c: F.col(f"mode{i}") for i, c in enumerate(others)}
    stats = stats.select("__rows", *[value[c].alias(f"__s{i}") for i, c in enumerate(chosen)])
    at = {c: i for i, c in enumerate(chosen)}

    def filled(c: str) -> Column:
        value = F.col(f"__s{at[c]}")
        kind = df.schema[c].dataType
        if c in numbers:
            return F.coalesce(qcol(c).cast("double"), value).alias(c)
        if kind.typeName() == "string":
            value = F.when(F.col("__rows") == 0, F.lit("missing")).otherwise(value)
        return F.coalesce(qcol(c), value.cast(kind)).alias(c)

    return df.crossJoin(F.broadcast(stats)).select(*[filled(c) if c in at else qcol(c) for c in df.columns])  # one row


def best_choices(values: DataFrame, vocabulary: DataFrame, scorer: str = "levenshtein") -> DataFrame:
    """(value, choice, score): the best entry of a vocabulary for each distinct
    value, the first in order of equals. The vocabulary is dealt into blocks of
    about ``VOCABULARY_BLOCK`` entries by hash and one block at a time is broadcast,
    so neither side has to be small; a value keeps its best of each task only."""
    score = levenshtein_score if scorer == "levenshtein" else (lambda a, b: similarity(a, b, scorer))
    n = vocabulary.count()
    blocks = max(1, -(-n // VOCABULARY_BLOCK))
    out = None
    for i in range(blocks):
        part = vocabulary if blocks == 1 else vocabulary.where(F.pmod(F.xxhash64("choice"), F.lit(blocks)) == i)
        pairs = values.crossJoin(F.broadcast(part)).withColumn("score", score(F.col("value"), F.col("choice")))
        best = pairs.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "choice")).alias("b"))
        out = best if out is None else out.unionAll(best)
    return out.groupBy("value").agg(F.min("b").alias("b")).select("value", F.col("b.choice").alias("choice"), (-F.col("b.s")).alias("score"))


def fix_typos(df: DataFrame, reference: DataFrame, column: str, scorer: str = "levenshtein", min_score: float = 0.0) -> DataFrame:
    """Values outside the reference's vocabulary become its best match, if that
    scores ``min_score`` or more; NULL stays, and an empty vocabulary changes
    nothing. Only distinct unknown values are scored."""
    known = reference.select(qcol(column).alias("choice")).where("choice is not null").distinct()
    unknown = df.select(qcol(column).alias("value")).where("value is not null").distinct().join(known, F.col("value") == F.col("choice"), "left_anti")
    fixes = best_choices(unknown, known, scorer).where(F.col("score") >= min_score).select(F.col("value").alias("__value"), F.col("choice").alias("__choice"))
    joined = df.join(fixes, qcol(column) == F.col("__value"), "left")
    return joined.select(*[F.coalesce("__choice", qcol(c)).alias(c) if c == column else qcol(c) for c in df.columns])


def cap_range(df: DataFrame, column: str, reference: DataFrame | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Numbers outside the bounds become the bound; bounds not given are the
    reference's least and greatest value. Other types stay as they are."""
    if not is_numeric(df, column):
        return df
    kind = df.schema[column].dataType
    base = (reference if reference is not None else df).agg(F.min(qcol(column)).alias("__lo"), F.max(qcol(column)).alias("__hi"))
    lo, hi = (F.col("__lo") if low is None else F.lit(low)).cast(kind), (F.col("__hi") if high is None else F.lit(high)).cast(kind)
    return df.crossJoin(F.broadcast(base)).select(*[clip(qcol(c), lo, hi).alias(c) if c == column else qcol(c) for c in df.columns])  # one row


def repair(df: DataFrame, reference: DataFrame | None = None, strategy: str = DEFAULT_STRATEGY, scorer: str = "levenshtein") -> DataFrame:
    """Impute, then correct text against the reference's vocabulary, then cap
    numbers to its range. Without a reference the data are their own, and only
    missing values change."""
    ref = df if reference is None else reference
    out = impute(df, ref, strategy)
    if reference is None:
        return out
    numbers, others = column_types(df)
    for c in [c for c in others if c in ref.columns and df.schema[c].dataType.typeName() == "string"]:
        out = fix_typos(out, ref, c, scorer)
    for c in [c for c in numbers if c in ref.columns]:
        out = cap_range(out, c, ref)
    return out
