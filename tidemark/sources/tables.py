"""Reading tables, rules and abbreviations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import fold_nan, qcol
from tidemark.sources.shared import kept, read_text

# Field texts that mean "no value" in typed reading.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    all_text: bool = False,
    blank_is_missing: bool = True,
    na_tokens: Sequence[str] = NA_TOKENS,
    lower_headers: bool = False,
    encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
    schema: str | None = None,
    order_by: Sequence[str] | None = None,
    row_id: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV or Parquet table from any store that Spark reaches (local, s3a, ...).

    CSV, ``all_text``: every column is text and a blank field is NULL, or ``''`` if
    ``blank_is_missing`` is false. CSV otherwise: ``na_tokens`` are NULL and types
    are those all remaining values of a column have. A file whose first encoding
    does not fit is read with the next. Files are split among tasks unless a field
    goes on over a line end, which an odd number of quotes in a line shows: one pass
    over the raw lines looks for these and for the encoding (``multi_line`` sets the
    first by hand). ``row_id`` names a dense id column, in the
    order of ``order_by``, or of the file."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = _csv(spark, path, encodings, schema, multi_line)
        if not all_text and schema is None:
            df = infer_types(df.select(*[F.when(~qcol(c).isin(*na_tokens), qcol(c)).alias(c) for c in df.columns]))
        elif not blank_is_missing:
            df = df.select(*[F.coalesce(qcol(c), F.lit("")).alias(c) if t == "string" else qcol(c) for c, t in df.dtypes])
    df = fold_nan(df)
    if lower_headers:
        df = normalise_headers(df)
    return with_row_id(df, order_by, row_id) if row_id else df


def _csv(spark: SparkSession, path: str, encodings: Sequence[str], schema: str | None, multi_line: bool | None) -> DataFrame:
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open")
    ).first()
    utf8 = [e for e in encodings if e.upper().replace("-", "") == "UTF8"]
    encoding = encodings[0] if encodings[0] not in utf8 or seen.utf8 or len(encodings) == 1 else encodings[1]
    reader = spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
    reader = reader.option("multiLine", bool(seen.open) if multi_line is None else multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become BIGINT or DOUBLE where every value is one; one pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    fits = df.agg(
        *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(F.when(qcol(c).rlike(r"^[+-]?[0-9]+$"), qcol(c).try_cast("bigint"))).alias(f"l{i}") for i, c in enumerate(texts)],
        *[F.count(F.when(~qcol(c).rlike("[dDfF]$"), qcol(c).try_cast("double"))).alias(f"d{i}") for i, c in enumerate(texts)],
    ).first()
    kind = {c: "bigint" if fits[f"l{i}"] == fits[f"n{i}"] > 0 else "double" if fits[f"d{i}"] == fits[f"n{i}"] > 0 else None for i, c in enumerate(texts)}
    return df.select(*[qcol(c).try_cast(kind[c]).alias(c) if kind.get(c) else qcol(c) for c in df.columns])


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "row_id") -> DataFrame:
    """Adds a dense BIGINT id from 0 in the order of ``order_by``, or of the input.

    Rows are ranked within partitions, and the partitions' sizes give the offsets. A
    second run of the plan could deal rows otherwise (range bounds come from a new
    sample), so the ranked rows are written once to the shared folder and both the
    sizes and the result read that table. Rows equal in all of ``order_by`` take
    their ids in any order; an empty table stays empty."""
    at, place = "__at", "__part"
    if order_by:
        keys = [qcol(c) for c in order_by]
        df = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ranked = df.withColumn(at, F.monotonically_increasing_id())
    ranked = kept(ranked.withColumns({place: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)}), "row-id")
    sizes = ranked.groupBy(place).agg(F.count("*").alias("__n"))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select(place, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranked.join(F.broadcast(starts), place).select(*[qcol(c) for c in df.columns], (F.col("__start") + F.col(at)).cast("bigint").alias(name))


def read_datasets(spark: SparkSession, paths: dict[str, str], **options) -> list[tuple[str, DataFrame]]:
    """Named tables in order, headers trimmed and lower-cased; at least two."""
    if len(paths) < 2:
        raise ValueError("two tables or more are needed")
    return [(name, read_table(spark, path, lower_headers=True, **options)) for name, path in paths.items()]


def read_rules(path: str, spark: SparkSession | None = None) -> tuple[dict[str, str], dict[str, dict]]:
    """(patterns, metrics) of a JSON rule file; either part may be absent. With a
    session the file may be in any store that Spark reaches."""
    rules = json.loads(read_text(path, spark))
    return rules.get("patterns", {}), rules.get("metrics", {})


def apply_rules(inferred: dict, given: dict, mode: str = "merge") -> dict:
    """Given rules on top of inferred ones (merge), or instead of them (replace)."""
    if mode not in ("merge", "replace"):
        raise ValueError("mode is merge or replace")
    return {**inferred, **given} if mode == "merge" else dict(given or inferred)


def read_abbreviations(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    """short -> full, in file order, from a YAML mapping, in any store with a session."""
    text = read_text(path, spark)
    try:
        import yaml
    except ImportError:
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
        return {k.strip(): v.strip() for k, v in pairs}
    return {str(k): str(v) for k, v in (yaml.safe_load(text) or {}).items()}


def default_reference(error: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The reference table; the data themselves where none is given, and then no
    value can be out of vocabulary or range."""
    return error if reference is None else reference
