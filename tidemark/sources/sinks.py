"""Writing tables, reports and the data behind charts."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import numeric_columns, qcol
from tidemark.operators.profile import summary
from tidemark.operators.rules import INVALID, MISSING
from tidemark.operators.score import change_table
from tidemark.sources.shared import write_text

# Cell colours of marked tables, by report.
STYLES = {
    "validator": {MISSING: "FFFF00", INVALID: "FF0000"},
    "reviewed": {MISSING: "FF0000", INVALID: "00FF00"},
    "cleaned": {MISSING: "FFFF00", INVALID: "00FF00"},
}
ERROR_COLOUR, CORRECTION_COLOUR = "FFCCCC", "CCFFCC"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; array columns become text joined by commas."""
    flat = [F.concat_ws(", ", qcol(c)).alias(c) if t.startswith("array") else qcol(c) for c, t in df.dtypes]
    writer = df.select(*flat).write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet to any store that Spark reaches."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_pairs(pairs: DataFrame, unique: DataFrame, path: str, duplicate: float = 80.0, similar: float = 60.0) -> None:
    """Three CSV folders below ``path``: duplicates, similar and unique."""
    named = pairs.select(F.col("record1").alias("Record 1"), F.col("record2").alias("Record 2"), F.col("score").alias("Similarity Score"), F.col("contributing_columns").alias("Contributing Columns"))
    write_csv(named.where(qcol("Similarity Score") >= duplicate), f"{path}/duplicates")
    write_csv(named.where((qcol("Similarity Score") >= similar) & (qcol("Similarity Score") < duplicate)), f"{path}/similar")
    write_csv(unique.select(F.col("record").alias("Record"), F.col("uniqueness").alias("Uniqueness Score")), f"{path}/unique")


def write_classes(df: DataFrame, path: str, column: str = "record_class") -> None:
    """Rows by record class, one folder a class."""
    df.write.mode("overwrite").partitionBy(column).option("header", True).csv(path)


def style_table(issues: DataFrame, report: str = "validator") -> DataFrame:
    """An issue table with the colour of each cell."""
    colours = STYLES[report]
    return issues.withColumn("colour", F.when(F.col("issue_type") == MISSING, colours[MISSING]).when(F.col("issue_type") == INVALID, colours[INVALID]))


def error_and_correction_styles(error: DataFrame, corrected: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The changed cells, coloured as errors (old values) and corrections (new)."""
    changes = change_table(error, corrected, row_id)
    cells = lambda value, colour: changes.select("row_id", "column_name", F.col(value).alias("value"), F.lit(colour).alias("colour"))
    return cells("old_value", ERROR_COLOUR), cells("new_value", CORRECTION_COLOUR)


def write_workbook(df: DataFrame, styles: DataFrame, path: str, row_id: str = "row_id", most_rows: int = 100_000) -> None:
    """A spreadsheet with coloured cells, for tables of at most ``most_rows`` rows
    (a sheet's own limit is about a million). Needs openpyxl."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import PatternFill
    except ImportError as e:
        raise ImportError("spreadsheets need openpyxl; the style table holds the same content") from e
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows: write CSV and the style table")
    book = Workbook()
    sheet = book.active
    sheet.append(df.columns)
    place = {}
    for n, row in enumerate(df.orderBy(row_id).collect(), start=2):
        sheet.append([None if v is None else v if isinstance(v, int | float | str | bool) else str(v) for v in row])
        place[row[row_id]] = n
    for r in styles.collect():
        sheet.cell(place[r.row_id], df.columns.index(r.column_name) + 1).fill = PatternFill("solid", start_color=r.colour)
    book.save(path)


def save_report(path: str, df: DataFrame, performance: dict) -> None:
    """Summary, scores and time as one JSON document, in any store that Spark reaches."""
    rows = [r.asDict() for r in summary(df).collect()]  # one row a column
    report = {"timestamp": datetime.now(timezone.utc).isoformat(), "summary": rows, "performance": performance}
    write_text(path, json.dumps(report, indent=2, default=str), df.sparkSession)


def metric_chart(found: DataFrame) -> DataFrame:
    """(column_name, completeness, entropy, unique_ratio), 0 where absent."""
    return found.select(
        "column_name",
        F.coalesce("completeness_ratio", F.lit(0.0)).alias("completeness"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.coalesce("unique_ratio", F.lit(0.0)).alias("unique_ratio"),
    )


def history_chart(history: DataFrame) -> DataFrame:
    """(iteration, impurity, fpr) in order of iteration."""
    return history.select("iteration", "impurity", "fpr").orderBy("iteration")


def report_chart(report: DataFrame) -> DataFrame:
    """(label, metric, value) of the classes of a class report."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")]))
    return report.where(~F.col("label").isin("accuracy", "macro avg", "weighted avg")).select("label", cells.alias("c")).select("label", "c.*")


def histograms(df: DataFrame, cols: list[str] | None = None, bins: int = 30) -> DataFrame:
    """(column_name, bin, low, high, n): equal bins between each column's ends."""
    cols = cols or numeric_columns(df)
    ends = df.agg(*[f(qcol(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), qcol(c).cast("double").alias("v"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(cols)]))
    flat = df.crossJoin(F.broadcast(ends)).select(cells.alias("c")).select("c.*").where("v is not null")  # one row of ends
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = flat.groupBy("column_name", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("column_name", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def box_plots(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, q25, q50, q75, low, high): quartiles and the fences at 1.5
    times their distance."""
    from tidemark.operators.profile import describe

    spread = 1.5 * (F.col("q75") - F.col("q25"))
    return describe(df, cols).select("column_name", "q25", "q50", "q75", (F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"))


def preview(df: DataFrame, row_id: str, n: int = 50) -> DataFrame:
    return df.orderBy(row_id).limit(n)
