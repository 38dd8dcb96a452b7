"""Column names, type classes, casts, date parts, scaling and schema alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss")


def qcol(name: str) -> Column:
    """A column by its full name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    """Any number type counts; booleans do not."""
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def column_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, all others)."""
    numbers = numeric_columns(df)
    return numbers, [c for c in df.columns if c not in numbers]


def three_way_types(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(text, numeric, date); columns of other types are in none."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]
    return text_columns(df), numeric_columns(df), dates


def shared_columns(a: DataFrame, b: DataFrame, kind: str | None = None) -> list[str]:
    """Names both tables have, sorted; of one ``kind`` (text, numeric) on both sides."""
    of = {"text": text_columns, "numeric": numeric_columns}.get(kind or "", lambda d: d.columns)
    return sorted(set(of(a)) & set(of(b)))


def as_text(name: str) -> Column:
    """The value as text; NULL stays NULL."""
    return qcol(name).cast("string")


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN of floating columns becomes NULL, the one missing value."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select(*[F.when(~F.isnan(qcol(c)), qcol(c)).alias(c) if c in floats else qcol(c) for c in df.columns])


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])


def with_date_parts(df: DataFrame, cols: list[str], formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Adds <c>_year, _month, _day; 0 where there is no date."""
    out = []
    for c in cols:
        kind = df.schema[c].dataType
        d = parse_date(qcol(c), formats) if isinstance(kind, T.StringType) else qcol(c)
        out += [F.coalesce(part(d), F.lit(0)).alias(f"{c}_{name}") for name, part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))]
    return df.select("*", *out)


def fill_text(df: DataFrame, placeholder: str = "MISSING") -> DataFrame:
    """NULL text becomes a placeholder; number columns keep their type and NULLs."""
    texts = set(text_columns(df))
    return df.select(*[F.coalesce(qcol(c), F.lit(placeholder)).alias(c) if c in texts else qcol(c) for c in df.columns])


def fill_numbers(df: DataFrame, value: float = 0.0, cols: list[str] | None = None) -> DataFrame:
    chosen = set(cols if cols is not None else numeric_columns(df))
    return df.select(*[F.coalesce(qcol(c), F.lit(value).cast(df.schema[c].dataType)).alias(c) if c in chosen else qcol(c) for c in df.columns])


def with_zscores(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds <c>_scaled: distance from the mean in population standard deviations,
    0 for a constant column. One aggregate row is joined to every row."""
    if not cols:
        return df
    stats = df.agg(*[f(qcol(c).cast("double")).alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = [F.when(F.col(f"__s{i}") == 0, F.when(qcol(c).isNotNull(), 0.0)).otherwise((qcol(c) - F.col(f"__m{i}")) / F.col(f"__s{i}")).alias(f"{c}_scaled") for i, c in enumerate(cols)]
    return joined.select(*[qcol(c) for c in df.columns], *out)


def with_minmax(df: DataFrame, cols: list[str], base: DataFrame | None = None) -> DataFrame:
    """Replaces ``cols`` by their place between the least and greatest value of
    ``base`` (the table itself by default); 0 where these are equal."""
    stats = (base if base is not None else df).agg(*[f(qcol(c)).cast("double").alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    at = {c: i for i, c in enumerate(cols)}

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"__lo{at[c]}"), F.col(f"__hi{at[c]}")
        return F.when(hi == lo, F.when(qcol(c).isNotNull(), 0.0)).otherwise((qcol(c) - lo) / (hi - lo)).alias(c)

    return df.crossJoin(F.broadcast(stats)).select(*[scaled(c) if c in at else qcol(c) for c in df.columns])  # one row


def with_text(df: DataFrame, cols: list[str], to: str = "__text") -> DataFrame:
    """Adds ``cols``, in sorted order, joined by blanks; NULL counts as empty."""
    return df.withColumn(to, F.concat_ws(" ", *[F.coalesce(as_text(c), F.lit("")) for c in sorted(cols)]))


def aligned_union(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def preview_change(before: DataFrame, after: DataFrame, row_id: str, cols: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of some columns before and after a step."""
    old = before.select(qcol(row_id), *[qcol(c).alias(f"{c}_before") for c in cols])
    new = after.select(qcol(row_id), *[qcol(c).alias(f"{c}_after") for c in cols])
    return old.join(new, row_id).orderBy(row_id).limit(n)


def feature_matrix(df: DataFrame, numbers: list[str], categories: list[str], to: str = "features") -> DataFrame:
    """Mean-imputed, scaled numbers beside one-hot categories with a category of
    their own for missing values; values unseen in fitting have no bit set."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    means = df.agg(*[F.avg(qcol(c)).alias(c) for c in numbers]).first() if numbers else None
    filled = df.select(
        "*",
        *[F.coalesce(qcol(c).cast("double"), F.lit(means[c]), F.lit(0.0)).alias(f"__n{i}") for i, c in enumerate(numbers)],
        *[F.coalesce(as_text(c), F.lit("missing")).alias(f"__c{i}") for i, c in enumerate(categories)],
    )
    filled = with_zscores(filled, [f"__n{i}" for i in range(len(numbers))])
    k = len(categories)
    stages = []
    if k:
        stages += [
            StringIndexer(inputCols=[f"__c{i}" for i in range(k)], outputCols=[f"__i{i}" for i in range(k)], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"__i{i}" for i in range(k)], outputCols=[f"__o{i}" for i in range(k)], dropLast=True),
        ]
    stages.append(VectorAssembler(inputCols=[f"__n{i}_scaled" for i in range(len(numbers))] + [f"__o{i}" for i in range(k)], outputCol=to))
    out = Pipeline(stages=stages).fit(filled).transform(filled)
    return out.select(*[qcol(c) for c in df.columns if c != to], to)
