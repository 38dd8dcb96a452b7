"""Profiles, counts, patterns and what charts are drawn from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import profile as A
from tidemark.operators import validate as V
from tidemark.plans.base import class_sql, dirty, dirty_sql, query, sql_text, table, union_sql
from tidemark.sources import sinks

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER = ["c_name", "c_acctbal", "c_mktsegment"]


def _rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@query(
    "profile_numeric",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, count(DISTINCT {c}) / count(*) AS unique_ratio, count({c}) / count(*) AS completeness_ratio FROM lineitem"
            for c in NUMBERS
        ]
    ),
)
def profile_numeric(spark, sf_dir):
    return A.profile(table(spark, sf_dir, "lineitem"), NUMBERS).select("column_name", "mean", "std", "unique_ratio", "completeness_ratio")


def _profile_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, "
        f"round((SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})), 6) AS entropy, "
        f"round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio, round(count({c}) / count(*), 6) AS completeness_ratio FROM {t}"
    )


@query("profile_categorical", union_sql([_profile_sql("orders", "o_orderstatus"), _profile_sql("orders", "o_orderpriority"), _profile_sql("events", "event_type")]))
def profile_categorical(spark, sf_dir):
    out = A.profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).unionAll(A.profile(table(spark, sf_dir, "events"), ["event_type"]))
    return _rounded(out.select("column_name", "mode", "entropy", "unique_ratio", "completeness_ratio"), "entropy", "unique_ratio", "completeness_ratio")


@query("profile_dirty", f"WITH {dirty_sql('customer')} " + union_sql([_profile_sql("dirty", "c_name"), _profile_sql("dirty", "c_mktsegment")]))
def profile_dirty(spark, sf_dir):
    out = A.profile(dirty(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return _rounded(out.select("column_name", "mode", "entropy", "unique_ratio", "completeness_ratio"), "entropy", "unique_ratio", "completeness_ratio")


@query(
    "describe_quartiles",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"
            for c in NUMBERS
        ]
    ),
)
def describe_quartiles(spark, sf_dir):
    return _rounded(A.describe(table(spark, sf_dir, "lineitem"), NUMBERS), "mean", "std", "q25", "q50", "q75")


@query(
    "box_plots",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, round(q1, 6) AS q25, round(q2, 6) AS q50, round(q3, 6) AS q75, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"
            for c in NUMBERS
        ]
    ),
)
def box_plots(spark, sf_dir):
    return _rounded(sinks.box_plots(table(spark, sf_dir, "lineitem"), NUMBERS), "q25", "q50", "q75", "low", "high")


@query(
    "correlations",
    union_sql([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(sorted(NUMBERS)) for b in sorted(NUMBERS)[i + 1 :]]),
)
def correlations(spark, sf_dir):
    return _rounded(A.correlations(table(spark, sf_dir, "lineitem"), NUMBERS), "r")


@query(
    "missing_counts",
    f"WITH {dirty_sql('customer')} "
    + union_sql(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS STRING) = '') AS missing, "
            f"count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS STRING)) = '') AS blank FROM dirty"
            for c in CUSTOMER
        ]
    ),
)
def missing_counts(spark, sf_dir):
    return A.missing_counts(dirty(spark, sf_dir, "customer"), CUSTOMER)


@query("distinct_counts", f"WITH {dirty_sql('customer')} " + union_sql([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS \"distinct\" FROM dirty" for c in CUSTOMER]))
def distinct_counts(spark, sf_dir):
    return A.distinct_counts(dirty(spark, sf_dir, "customer"), CUSTOMER)


@query(
    "value_counts",
    f"WITH {dirty_sql('customer')} SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment",
)
def value_counts(spark, sf_dir):
    return _rounded(A.value_counts(dirty(spark, sf_dir, "customer"), ["c_mktsegment"], normalize=True), "share")


@query("ranges", union_sql([f"SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high FROM lineitem" for c in NUMBERS]))
def ranges(spark, sf_dir):
    return A.ranges(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(
    "dataset_summary",
    f"WITH {dirty_sql('customer')} "
    + union_sql([f"SELECT '{c}' AS column_name, count(*) AS rows, round(100 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS missing_percent FROM dirty" for c in ["c_custkey", *CUSTOMER]]),
)
def dataset_summary(spark, sf_dir):
    return _rounded(A.summary(dirty(spark, sf_dir, "customer").select("c_custkey", *CUSTOMER)).drop("type"), "missing_percent")


DUPLICATES = "rep AS (SELECT doc_id, lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) AS r FROM documents) WHERE r > 1)"


@query("duplicate_rows", f"WITH {DUPLICATES} SELECT doc_id FROM rep")
def duplicate_rows(spark, sf_dir):
    return A.duplicate_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id").select("doc_id")


@query(
    "duplicate_values",
    f"WITH {DUPLICATES} SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM rep GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM rep GROUP BY source "
    "UNION ALL SELECT 'text', text, count(*) FROM rep GROUP BY text",
)
def duplicate_values(spark, sf_dir):
    return A.duplicate_values(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


PATTERNED = {"orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type"], "customer": ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]}


def _patterns_sql(ruleset: int) -> str:
    several = "'(' || string_agg(p, '|' ORDER BY p) || ')'" if ruleset == 1 else "string_agg(p, '|' ORDER BY p)"
    return union_sql(
        [
            f"SELECT '{c}' AS column_name, CASE WHEN count(*) = 1 THEN min(p) ELSE {several} END AS pattern "
            f"FROM (SELECT DISTINCT {class_sql('v', ruleset)} AS p FROM (SELECT CAST({c} AS STRING) AS v FROM {t} WHERE {c} IS NOT NULL))"
            for t, cols in PATTERNED.items()
            for c in cols
        ]
    )


def _patterns(spark, sf_dir, ruleset):
    found = [A.infer_patterns(table(spark, sf_dir, t), cols, ruleset=ruleset) for t, cols in PATTERNED.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("infer_patterns", _patterns_sql(1))
def infer_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir, 1)


@query("infer_patterns_history", _patterns_sql(2))
def infer_patterns_history(spark, sf_dir):
    return _patterns(spark, sf_dir, 2)


@query(
    "valid_percentages",
    f"WITH {dirty_sql('orders')} SELECT 'o_orderstatus' AS column_name, round(100 * avg(CASE WHEN regexp_full_match(o_orderstatus, '^[A-Z]$') THEN 1 ELSE 0 END), 6) AS valid_percentage FROM dirty "
    "UNION ALL SELECT 'o_orderpriority', round(100 * avg(CASE WHEN o_orderpriority IS NULL THEN NULL WHEN regexp_full_match(o_orderpriority, '\\d-.*') THEN 1 ELSE 0 END), 6) FROM dirty",
)
def valid_percentages(spark, sf_dir):
    return _rounded(A.valid_percentages(dirty(spark, sf_dir, "orders"), {"o_orderstatus": "^[A-Z]$", "o_orderpriority": r"\d-.*"}), "valid_percentage")


LOWER, PUNCTUATED = "({c} = lower({c}) AND lower({c}) <> upper({c}))", "regexp_matches({c}, '[^\\w\\s]')"


@query(
    "majority_shares",
    f"WITH {dirty_sql('part')} "
    + union_sql(
        [
            f"SELECT '{c}' AS column_name, round(avg(CAST({LOWER.format(c=c)} AS INT)), 6) AS lower_share, round(avg(CAST({PUNCTUATED.format(c=c)} AS INT)), 6) AS punctuation_share FROM dirty"
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
)
def majority_shares(spark, sf_dir):
    return _rounded(A.majority_shares(dirty(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]), "lower_share", "punctuation_share")


@query(
    "first_rows_format",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, coalesce(bool_and({LOWER.format(c=c)}), true) AS all_lower, coalesce(bool_and(NOT {PUNCTUATED.format(c=c)}), true) AS none_punctuated "
            "FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20)"
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
)
def first_rows_format(spark, sf_dir):
    return A.first_rows_format(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query(
    "compare_history",
    f"WITH {dirty_sql('customer')}, h AS (SELECT avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, count(DISTINCT c_acctbal) / count(*) AS unique_ratio, count(c_acctbal) / count(*) AS completeness_ratio FROM customer), "
    "d AS (SELECT avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, count(DISTINCT c_acctbal) / count(*) AS unique_ratio, count(c_acctbal) / count(*) AS completeness_ratio FROM dirty), "
    "m AS ("
    + union_sql([f"SELECT '{m}' AS metric, d.{m} AS value, least(h.{m} * 0.95::DOUBLE, h.{m} * 1.05::DOUBLE) AS low, greatest(h.{m} * 0.95::DOUBLE, h.{m} * 1.05::DOUBLE) AS high FROM d, h" for m in ("mean", "std", "unique_ratio", "completeness_ratio")])
    + ") SELECT 'c_acctbal' AS column_name, metric, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM m WHERE value < low OR value > high",
)
def compare_history(spark, sf_dir):
    history = A.collect_profile(A.profile(table(spark, sf_dir, "customer"), ["c_acctbal"]))
    return _rounded(A.compare_history(A.profile(dirty(spark, sf_dir, "customer"), ["c_acctbal"]), history, 0.05), "value", "low", "high")


@query(
    "metric_chart",
    f"WITH {dirty_sql('customer')}, q AS ({union_sql([_profile_sql('dirty', 'c_name'), _profile_sql('dirty', 'c_mktsegment')])}) "
    "SELECT column_name, completeness_ratio AS completeness, entropy, unique_ratio FROM q",
)
def metric_chart(spark, sf_dir):
    return _rounded(sinks.metric_chart(A.profile(dirty(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])), "completeness", "entropy", "unique_ratio")


@query(
    "histograms",
    "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(CAST(floor((l_quantity - lo) / ((hi - lo) / 10)) AS INT), 9) AS bin, lo, hi FROM lineitem, e) "
    "SELECT 'l_quantity' AS column_name, bin, round(any_value(lo + bin * ((hi - lo) / 10)), 6) AS low, round(any_value(lo + (bin + 1) * ((hi - lo) / 10)), 6) AS high, count(*) AS n FROM b GROUP BY bin",
)
def histograms(spark, sf_dir):
    return _rounded(sinks.histograms(table(spark, sf_dir, "lineitem"), ["l_quantity"], 10), "low", "high")


@query(
    "date_parts",
    f"WITH {dirty_sql('orders')}, p AS (SELECT o_orderkey, coalesce(try_strptime(o_day, '%Y-%m-%d'), try_strptime(o_day, '%d/%m/%Y')) AS d FROM dirty) "
    "SELECT o_orderkey, CAST(coalesce(year(d), 0) AS INT) AS o_day_year, CAST(coalesce(month(d), 0) AS INT) AS o_day_month, CAST(coalesce(day(d), 0) AS INT) AS o_day_day FROM p",
)
def date_parts(spark, sf_dir):
    out = C.with_date_parts(dirty(spark, sf_dir, "orders"), ["o_day"])
    return out.select("o_orderkey", "o_day_year", "o_day_month", "o_day_day")


@query("zscore", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 4) + 0.0::DOUBLE AS l_extendedprice_scaled FROM lineitem")
def zscore(spark, sf_dir):
    out = C.with_zscores(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", (F.round("l_extendedprice_scaled", 4) + 0.0).alias("l_extendedprice_scaled"))


@query(
    "minmax",
    "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice FROM orders",
)
def minmax(spark, sf_dir):
    return _rounded(C.with_minmax(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")


@query(
    "edge_blanks",
    f"WITH {dirty_sql('customer')} " + union_sql([f"SELECT '{c}' AS column_name, bool_or(starts_with({c}, ' ')) AS leading, bool_or(ends_with({c}, ' ')) AS trailing FROM dirty" for c in ("c_name", "c_mktsegment")]),
)
def edge_blanks(spark, sf_dir):
    return V.edge_blanks(dirty(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query(
    "in_domain",
    f"SELECT o_orderkey, coalesce(o_orderstatus IN ('O', 'F'), false) AND coalesce(split_part(o_orderpriority, ' ', 1) IN ({sql_text('1-URGENT')}, {sql_text('2-HIGH')}, {sql_text('4-NOT')}, 'O', 'F'), false) AS known FROM orders",
)
def in_domain(spark, sf_dir):
    domain = ["1-URGENT", "2-HIGH", "4-NOT", "O", "F"]
    known = V.in_domain(["o_orderstatus"], ["O", "F"]) & V.in_domain(["o_orderpriority"], domain, code_only=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", known.alias("known"))
