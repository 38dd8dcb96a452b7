"""Validation, marking, imputation, correction and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import profile as A
from tidemark.operators import repair as R
from tidemark.operators import score as S
from tidemark.operators import validate as V
from tidemark.operators.rules import Bounds, compile_rules, constrained
from tidemark.plans.base import class_sql, dirty, dirty_sql, query, sql_text, table, union_sql
from tidemark.sources import sinks

ORDER_RULES = {"o_orderstatus": "^[A-Z]$", "o_orderpriority": r"^\d-[A-Z ]+$", "o_day": r"^\d{4}-\d{2}-\d{2}$"}
LEARNED = ["c_name", "c_acctbal", "c_mktsegment"]


def _entries_sql(test: str) -> str:
    return f"WITH {dirty_sql('orders')} " + union_sql(
        [f"SELECT o_orderkey AS row_id, '{c}' AS column_name, {c} AS value FROM dirty WHERE {c} IS NOT NULL AND NOT " + test.format(c=c, p=sql_text(p), q=sql_text(f"^(?:{p[:-1]})")) for c, p in ORDER_RULES.items()]
    )


@query("invalid_entries_full", _entries_sql("regexp_full_match({c}, {p})"))
def invalid_entries_full(spark, sf_dir):
    return V.invalid_entries(dirty(spark, sf_dir, "orders"), ORDER_RULES, "o_orderkey")


@query("invalid_entries_prefix", _entries_sql("({c} = '' OR regexp_matches({c}, {q}))"))
def invalid_entries_prefix(spark, sf_dir):
    prefixes = {c: p[:-1] for c, p in ORDER_RULES.items()}
    return V.invalid_entries(dirty(spark, sf_dir, "orders"), prefixes, "o_orderkey", match="prefix", blank_ok=True)


@query("invalid_entries_null_text", f"WITH {dirty_sql('orders')} SELECT o_orderkey AS row_id, 'o_orderpriority' AS column_name, coalesce(o_orderpriority, 'nan') AS value FROM dirty WHERE NOT regexp_matches(coalesce(o_orderpriority, 'nan'), '^(?:\\d-)')")
def invalid_entries_null_text(spark, sf_dir):
    return V.invalid_entries(dirty(spark, sf_dir, "orders"), {"o_orderpriority": r"\d-"}, "o_orderkey", match="prefix", null_text="nan")


@query("invalid_columns", f"WITH e AS ({_entries_sql('regexp_full_match({c}, {p})')}) SELECT DISTINCT column_name FROM e")
def invalid_columns(spark, sf_dir):
    return V.invalid_columns(dirty(spark, sf_dir, "orders"), ORDER_RULES)


@query("summarize_invalid", f"WITH e AS ({_entries_sql('regexp_full_match({c}, {p})')}) SELECT column_name, count(*) AS n FROM e GROUP BY column_name")
def summarize_invalid(spark, sf_dir):
    return V.summarize_invalid(V.invalid_entries(dirty(spark, sf_dir, "orders"), ORDER_RULES, "o_orderkey"))


@query("valid_masks", f"WITH {dirty_sql('orders')} SELECT o_orderkey, " + ", ".join(f"{c} IS NULL OR regexp_full_match({c}, {sql_text(p)}) AS valid_{c}" for c, p in ORDER_RULES.items()) + " FROM dirty")
def valid_masks(spark, sf_dir):
    return V.valid_masks(dirty(spark, sf_dir, "orders"), ORDER_RULES).select("o_orderkey", *[f"valid_{c}" for c in ORDER_RULES])


@query("rule_violations", f"WITH e AS ({_entries_sql('regexp_full_match({c}, {p})')}) SELECT row_id, column_name, 'INVALID' AS issue_type FROM e")
def rule_violations(spark, sf_dir):
    return V.rule_violations(dirty(spark, sf_dir, "orders"), compile_rules(ORDER_RULES), "o_orderkey")


@query(
    "constraint_violations",
    "SELECT c_custkey AS row_id, 'c_acctbal' AS column_name, 'min' AS bound FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_acctbal', 'max' FROM customer WHERE c_acctbal > 9000 "
    "UNION ALL SELECT c_custkey, 'c_mktsegment', 'mode' FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
def constraint_violations(spark, sf_dir):
    limits = {"c_acctbal": {"min": 0, "max": 9000}, "c_mktsegment": {"mode": "BUILDING"}, "absent": {"min": 1}}
    return V.constraint_violations(table(spark, sf_dir, "customer"), limits, "c_custkey").drop("value")


def _learned_sql() -> str:
    """Pattern tests of the dirty columns against the classes seen in the clean ones."""
    return ", ".join(f"p_{c} AS (SELECT DISTINCT {class_sql('v')} AS p FROM (SELECT CAST({c} AS STRING) AS v FROM customer WHERE {c} IS NOT NULL))" for c in LEARNED)


def _mark(c: str) -> str:
    v = f"CAST({c} AS STRING)"
    return f"CASE WHEN {c} IS NULL OR {v} = '' THEN 'MISSING' WHEN NOT EXISTS (SELECT 1 FROM p_{c} WHERE regexp_full_match({v}, p)) THEN 'INVALID' ELSE {v} END"


MARKED = f"WITH {dirty_sql('customer')}, {_learned_sql()}, marked AS (SELECT c_custkey, {', '.join(f'{_mark(c)} AS {c}' for c in LEARNED)} FROM dirty)"


def _marked(spark, sf_dir):
    clean, bad = table(spark, sf_dir, "customer"), dirty(spark, sf_dir, "customer")
    rules = compile_rules(A.collect_patterns(A.infer_patterns(clean, LEARNED)))
    return R.mark_issues(bad, rules).select("c_custkey", *LEARNED), bad


@query("mark_issues", f"{MARKED} SELECT * FROM marked")
def mark_issues(spark, sf_dir):
    return _marked(spark, sf_dir)[0]


@query(
    "issue_counts",
    f"{MARKED} "
    + union_sql(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} = 'MISSING') AS missing, count(*) FILTER (WHERE {c} = 'INVALID') AS invalid, count(*) FILTER (WHERE {c} IN ('MISSING', 'INVALID')) AS issues FROM marked"
            for c in LEARNED
        ]
    ),
)
def issue_counts(spark, sf_dir):
    return R.issue_counts(_marked(spark, sf_dir)[0], LEARNED)


STYLED = union_sql([f"SELECT m.c_custkey AS row_id, '{c}' AS column_name, CAST(d.{c} AS STRING) AS value, m.{c} AS issue_type FROM marked m JOIN dirty d USING (c_custkey) WHERE m.{c} IN ('MISSING', 'INVALID')" for c in LEARNED])


@query("styled_issues", f"{MARKED}, i AS ({STYLED}) SELECT *, CASE issue_type WHEN 'MISSING' THEN 'FFFF00' ELSE 'FF0000' END AS colour FROM i")
def styled_issues(spark, sf_dir):
    marked, bad = _marked(spark, sf_dir)
    return sinks.style_table(R.issue_table(marked, bad, "c_custkey", LEARNED))


@query(
    "constrained_cells",
    f"WITH {dirty_sql('customer')}, b AS (SELECT c_custkey, regexp_replace(CAST(c_nationkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END, '[^A-Za-z0-9\\s]', '', 'g') AS v FROM dirty) "
    "SELECT c_custkey, CASE WHEN TRY_CAST(v AS DOUBLE) < 5 THEN '5' WHEN TRY_CAST(v AS DOUBLE) > 20 THEN '20' WHEN TRY_CAST(v AS DOUBLE) IS NULL AND v <> '7' THEN '7' ELSE v END AS v FROM b",
)
def constrained_cells(spark, sf_dir):
    df = dirty(spark, sf_dir, "customer")
    v = F.concat(F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, " x").otherwise(""))
    return df.select("c_custkey", Bounds(5, 20, "7").apply(v).alias("v"))


@query("clamped_numbers", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN '5' WHEN c_nationkey > 20 THEN '20' ELSE CAST(c_nationkey AS STRING) END AS v FROM customer")
def clamped_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", constrained(F.col("c_nationkey").cast("string"), 5, 20, None).alias("v"))


PLAIN = {"p_name": r"^[a-z ]+$", "p_brand": r"^Brand#\d+$"}


def _broken(c: str) -> str:
    return f"NOT regexp_matches({c}, '^(?:{PLAIN[c][1:]})')"


@query("clean_by_pattern", f"WITH {dirty_sql('part')} SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} <> '' AND {_broken(c)} THEN regexp_replace({c}, '[^A-Za-z0-9\\s.,-]', '', 'g') ELSE {c} END AS {c}" for c in PLAIN) + " FROM dirty")
def clean_by_pattern(spark, sf_dir):
    return R.clean_by_pattern(dirty(spark, sf_dir, "part"), PLAIN).select("p_partkey", *PLAIN)


@query("mark_invalid", f"WITH {dirty_sql('part')} SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} <> '' AND {_broken(c)} THEN 'INVALID' ELSE {c} END AS {c}" for c in PLAIN) + " FROM dirty")
def mark_invalid(spark, sf_dir):
    return R.mark_invalid(dirty(spark, sf_dir, "part"), PLAIN).select("p_partkey", *PLAIN)


@query("mark_missing", f"WITH {dirty_sql('customer')} SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = '' THEN 'MISSING' ELSE c_name END AS c_name, CASE WHEN c_mktsegment IS NULL OR c_mktsegment = '' THEN 'MISSING' ELSE c_mktsegment END AS c_mktsegment FROM dirty")
def mark_missing(spark, sf_dir):
    return R.mark_missing(dirty(spark, sf_dir, "customer")).select("c_custkey", "c_name", "c_mktsegment")


@query("mask_missing", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_acctbal IS NULL AS is_missing_c_acctbal, c_mktsegment IS NULL AS is_missing_c_mktsegment FROM dirty")
def mask_missing(spark, sf_dir):
    return V.mask_missing(dirty(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"]).select("c_custkey", "is_missing_c_acctbal", "is_missing_c_mktsegment")


@query("mask_blank", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_name IS NULL OR c_name = '' AS is_blank_c_name FROM dirty")
def mask_blank(spark, sf_dir):
    return V.mask_blank(dirty(spark, sf_dir, "customer"), ["c_name"]).select("c_custkey", "is_blank_c_name")


@query("mask_typo", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_mktsegment IS NULL OR c_mktsegment NOT IN (SELECT c_mktsegment FROM customer) AS is_typo_c_mktsegment FROM dirty")
def mask_typo(spark, sf_dir):
    return V.mask_typos(dirty(spark, sf_dir, "customer"), table(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "is_typo_c_mktsegment")


BOUNDS = "(SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"


@query("mask_range", f"WITH {dirty_sql('customer')} SELECT c_custkey, coalesce(c_acctbal < lo OR c_acctbal > hi, false) AS is_out_of_range_c_acctbal FROM dirty, {BOUNDS}")
def mask_range(spark, sf_dir):
    return V.mask_out_of_range(dirty(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "customer")).select("c_custkey", "is_out_of_range_c_acctbal")


MODE = "(SELECT {c} FROM customer GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _impute(strategy: str, sql: str):
    @query(f"impute_{strategy}", f"WITH {dirty_sql('customer')} SELECT c_custkey, round(coalesce(c_acctbal, {sql}), 4) AS c_acctbal, coalesce(c_mktsegment, {MODE.format(c='c_mktsegment')}) AS c_mktsegment FROM dirty")
    def impute(spark, sf_dir):
        out = R.impute(dirty(spark, sf_dir, "customer"), table(spark, sf_dir, "customer"), strategy)
        return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")

    return impute


impute_mean = _impute("mean", "(SELECT avg(c_acctbal) FROM customer)")
impute_median = _impute("median", "(SELECT median(c_acctbal) FROM customer)")
impute_mode = _impute("mode", MODE.format(c="c_acctbal"))

FIXES = (
    "v AS (SELECT DISTINCT c_mktsegment AS choice FROM customer), u AS (SELECT DISTINCT c_mktsegment AS value FROM dirty WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN (SELECT choice FROM v)), "
    "f AS (SELECT value, choice FROM (SELECT value, choice, row_number() OVER (PARTITION BY value ORDER BY 1 - levenshtein(value, choice) / greatest(length(value), length(choice)) DESC, choice) AS r FROM u, v) WHERE r = 1)"
)


@query("fix_typos", f"WITH {dirty_sql('customer')}, {FIXES} SELECT c_custkey, coalesce(choice, c_mktsegment) AS c_mktsegment FROM dirty LEFT JOIN f ON c_mktsegment = value")
def fix_typos(spark, sf_dir):
    return R.fix_typos(dirty(spark, sf_dir, "customer"), table(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("fix_typos_weighted", f"WITH {dirty_sql('customer')}, {FIXES} SELECT c_custkey, coalesce(choice, c_mktsegment) AS c_mktsegment FROM dirty LEFT JOIN f ON c_mktsegment = value")
def fix_typos_weighted(spark, sf_dir):
    out = R.fix_typos(dirty(spark, sf_dir, "customer"), table(spark, sf_dir, "customer"), "c_mktsegment", "weighted")
    return out.select("c_custkey", "c_mktsegment")


@query("cap_range", f"WITH {dirty_sql('customer')} SELECT c_custkey, CASE WHEN c_acctbal < lo THEN lo WHEN c_acctbal > hi THEN hi ELSE c_acctbal END AS c_acctbal FROM dirty, {BOUNDS}")
def cap_range(spark, sf_dir):
    return R.cap_range(dirty(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "customer")).select("c_custkey", "c_acctbal")


REPAIRED = (
    f"{FIXES}, fixed AS (SELECT c_custkey, coalesce(choice, c_mktsegment, {MODE.format(c='c_mktsegment')}) AS c_mktsegment, "
    f"(SELECT least(greatest(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM customer)), lo), hi) FROM {BOUNDS}) AS c_acctbal FROM dirty LEFT JOIN f ON c_mktsegment = value)"
)


def _repaired(spark, sf_dir):
    bad, clean = dirty(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return bad, R.repair(bad, clean), clean


@query("repair", f"WITH {dirty_sql('customer')}, {REPAIRED} SELECT c_custkey, c_mktsegment, round(c_acctbal, 4) AS c_acctbal FROM fixed")
def repair(spark, sf_dir):
    return _repaired(spark, sf_dir)[1].select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))


@query(
    "change_table",
    f"WITH {dirty_sql('customer')}, {REPAIRED} SELECT c_custkey AS row_id, 'c_mktsegment' AS column_name, d.c_mktsegment AS old_value, x.c_mktsegment AS new_value "
    "FROM dirty d JOIN fixed x USING (c_custkey) WHERE d.c_mktsegment IS DISTINCT FROM x.c_mktsegment",
)
def change_table(spark, sf_dir):
    bad, fixed, _ = _repaired(spark, sf_dir)
    return S.change_table(bad, fixed, "c_custkey", ["c_mktsegment"])


REPORT = (
    "c AS (SELECT t, p, count(*) AS n FROM flags GROUP BY t, p), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT DISTINCT p FROM c), "
    "k AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0) AS hit, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS said, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS support FROM l), "
    "m AS (SELECT label, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re, support, hit FROM k), "
    "f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM m)"
)


@query(
    "repair_score",
    f"WITH {dirty_sql('customer')}, {REPAIRED.replace('f AS (', 'fx AS (').replace('JOIN f ON', 'JOIN fx ON')}, flags AS (SELECT CAST(d.c_mktsegment IS DISTINCT FROM r.c_mktsegment OR d.c_acctbal IS DISTINCT FROM r.c_acctbal AS STRING) AS t, "
    "CAST(d.c_mktsegment IS DISTINCT FROM x.c_mktsegment OR d.c_acctbal IS DISTINCT FROM x.c_acctbal AS STRING) AS p FROM dirty d JOIN fixed x USING (c_custkey) JOIN customer r USING (c_custkey)), "
    f"{REPORT} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f "
    "UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f "
    "UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f "
    "UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f",
)
def repair_score(spark, sf_dir):
    bad, fixed, clean = _repaired(spark, sf_dir)
    out = S.score_repair(bad, fixed, clean, "c_custkey")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


NAME = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(
    "normalize_text",
    f"WITH {dirty_sql('customer')} SELECT c_custkey, regexp_replace({NAME.format('lower(c_name)')}, '[^a-z0-9\\s]', '', 'g') AS normalized, regexp_replace(c_name, '[^\\w\\s]', '', 'g') AS bare, "
    "regexp_replace(c_name, '[^\\d.]', '', 'g') AS digits, regexp_replace(c_name, '[^A-Za-z0-9\\s]', '', 'g') AS plain FROM dirty",
)
def normalize_text(spark, sf_dir):
    c = F.col("c_name")
    return dirty(spark, sf_dir, "customer").select("c_custkey", T.normalize_text(c).alias("normalized"), T.remove_punctuation(c).alias("bare"), T.strip_currency(c).alias("digits"), T.alphanumeric(c).alias("plain"))


@query("normalize_documents", f"SELECT doc_id, md5(regexp_replace({NAME.format('lower(text)')}, '[^a-z0-9\\s]', '', 'g')) AS digest FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("expand_abbreviations", f"WITH {dirty_sql('part')} SELECT p_partkey, regexp_replace(regexp_replace(p_type, '(?i)\\bltd\\b', 'limited', 'g'), '(?i)\\bco\\b', 'company', 'g') AS p_type FROM dirty")
def expand_abbreviations(spark, sf_dir):
    return dirty(spark, sf_dir, "part").select("p_partkey", T.expand_abbreviations(F.col("p_type"), {"ltd": "limited", "co": "company"}).alias("p_type"))


FLAGS = (
    f"WITH {dirty_sql('customer')}, {REPAIRED.replace('f AS (', 'fx AS (').replace('JOIN f ON', 'JOIN fx ON')}, flags AS (SELECT CAST(d.c_mktsegment IS DISTINCT FROM r.c_mktsegment OR d.c_acctbal IS DISTINCT FROM r.c_acctbal AS STRING) AS t, "
    "CAST(d.c_mktsegment IS DISTINCT FROM x.c_mktsegment OR d.c_acctbal IS DISTINCT FROM x.c_acctbal AS STRING) AS p FROM dirty d JOIN fixed x USING (c_custkey) JOIN customer r USING (c_custkey))"
)


@query("report_chart", f"{FLAGS}, {REPORT} " + union_sql([f"SELECT label, '{m}' AS metric, round({c}, 6) AS value FROM f" for m, c in (("precision", "pr"), ("recall", "re"), ("f1", "f1"))]))
def report_chart(spark, sf_dir):
    bad, fixed, clean = _repaired(spark, sf_dir)
    return sinks.report_chart(S.score_repair(bad, fixed, clean, "c_custkey")).select("label", "metric", F.round("value", 6).alias("value"))


@query("repair_flags", f"{FLAGS} SELECT t AS is_error, p AS is_changed, count(*) AS n FROM flags GROUP BY t, p")
def repair_flags(spark, sf_dir):
    bad, fixed, clean = _repaired(spark, sf_dir)
    out = S.repair_flags(bad, fixed, clean, "c_custkey")
    return out.groupBy(F.col("is_error").cast("string").alias("is_error"), F.col("is_changed").cast("string").alias("is_changed")).agg(F.count("*").alias("n"))
