"""Queries that hold single operators against SQL: files read back, formats, splits,
similarities, filters, sources by mode."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import patterns as P
from tidemark.functions import text as T
from tidemark.operators import dedup as D
from tidemark.operators import learn as L
from tidemark.operators import profile as A
from tidemark.operators import resolve as E
from tidemark.operators import score as S
from tidemark.operators import synth as G
from tidemark.operators import validate as V
from tidemark.plans import match_queries as M
from tidemark.plans.base import class_sql, dirty, dirty_sql, query, sql_text, table, union_sql
from tidemark.plans.profile_queries import LOWER, PUNCTUATED
from tidemark.sources import sinks
from tidemark.sources import tables as R
from tidemark.sources.shared import read_text, shared_path, write_text

# --- files ---------------------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


@query("csv_typed", f"WITH {dirty_sql('customer')} SELECT c_custkey, nullif(c_name, '') AS c_name, c_acctbal, c_mktsegment FROM dirty")
def csv_typed(spark, sf_dir):
    path = shared_path(spark, "csv")
    sinks.write_csv(dirty(spark, sf_dir, "customer").select(*CUSTOMER).toDF(*[f" {c.upper()} " for c in CUSTOMER]), path)
    return R.read_table(spark, path, lower_headers=True)


@query("csv_text", f"WITH {dirty_sql('customer')} SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM dirty")
def csv_text(spark, sf_dir):
    path = shared_path(spark, "csv")
    sinks.write_csv(dirty(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return R.read_table(spark, path, all_text=True, blank_is_missing=False)


@query("csv_other_encoding", "SELECT n_nationkey, concat(n_name, ' éß') AS n_name FROM nation")
def csv_other_encoding(spark, sf_dir):
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" éß")).alias("n_name"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return R.read_table(spark, path)


@query("csv_lines_in_fields", "SELECT n_nationkey, concat('a ', chr(34), n_name, chr(34), chr(10), 'b, c') AS n_name FROM nation")
def csv_lines_in_fields(spark, sf_dir):
    path = shared_path(spark, "csv")
    text = F.concat(F.lit('a "'), "n_name", F.lit('"\nb, c'))
    sinks.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("n_name")), path)
    return R.read_table(spark, path)


@query("named_datasets", union_sql([f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in ("nation", "region")]))
def named_datasets(spark, sf_dir):
    sets = R.read_datasets(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "region")}, fmt="parquet")
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n") for name, d in sets]
    return counted[0].unionAll(counted[1])


@query(
    "pair_files",
    f"WITH {M.WINDOW}, {M._ENDS} SELECT 'duplicates' AS file, count(*) AS n FROM pairs WHERE score >= 80 UNION ALL SELECT 'similar', count(*) FROM pairs WHERE score >= 60 AND score < 80 "
    "UNION ALL SELECT 'unique', count(*) FROM part WHERE p_partkey NOT IN (SELECT r FROM ends)",
)
def pair_files(spark, sf_dir):
    path, pairs = shared_path(spark, "pairs"), M._window_pairs(spark, sf_dir)
    sinks.write_pairs(pairs, D.unique_records(M._parts(spark, sf_dir), pairs, "p_partkey"), path)
    counted = [spark.read.option("header", True).csv(f"{path}/{f}").agg(F.count("*").alias("n")).select(F.lit(f).alias("file"), "n") for f in ("duplicates", "similar", "unique")]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query("class_files", f"WITH q AS ({M._classes_sql('max')}) SELECT record_class, count(*) AS n, min(p_partkey) AS first FROM q GROUP BY record_class")
def class_files(spark, sf_dir):
    path = shared_path(spark, "classes")
    sinks.write_classes(M.record_classes(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path).groupBy(F.col("record_class").cast("int").alias("record_class")).agg(F.count("*").alias("n"), F.min(F.col("p_partkey").cast("bigint")).alias("first"))


@query("report_file", union_sql([f"SELECT '{c}' AS column_name, count(*) AS rows, 0.5::DOUBLE AS accuracy, true AS stamped FROM nation" for c in ("n_name", "n_nationkey", "n_regionkey")]))
def report_file(spark, sf_dir):
    path = f"{shared_path(spark, 'report')}.json"
    sinks.save_report(path, table(spark, sf_dir, "nation"), {"accuracy": 0.5})
    report = json.loads(read_text(path, spark))
    rows = [(r["column_name"], r["rows"], report["performance"]["accuracy"], report["timestamp"][:2] == "20") for r in report["summary"]]
    return spark.createDataFrame(rows, "column_name string, rows long, accuracy double, stamped boolean")


@query("rule_file", f"WITH {dirty_sql('orders')} SELECT 'o_orderstatus' AS column_name, count(*) AS n FROM dirty WHERE NOT regexp_full_match(o_orderstatus, '[A-Z]')")
def rule_file(spark, sf_dir):
    path = f"{shared_path(spark, 'rules')}.json"
    A.save_history(path, {"o_orderstatus": "^[A-Z]$"}, {}, spark)
    patterns, _ = R.read_rules(path, spark)
    rules = R.apply_rules({"o_orderstatus": ".*"}, patterns)
    return V.summarize_invalid(V.invalid_entries(dirty(spark, sf_dir, "orders"), rules, "o_orderkey"))


@query("abbreviation_file", f"WITH {dirty_sql('part')} SELECT p_partkey, regexp_replace(regexp_replace(p_type, '(?i)\\bco\\b', 'company', 'g'), '(?i)\\bltd\\b', 'limited', 'g') AS p_type FROM dirty")
def abbreviation_file(spark, sf_dir):
    path = f"{shared_path(spark, 'words')}.yaml"
    write_text(path, "co: company\nltd: limited\n", spark)
    return dirty(spark, sf_dir, "part").select("p_partkey", T.expand_abbreviations(F.col("p_type"), R.read_abbreviations(path, spark)).alias("p_type"))


@query("own_reference", f"WITH {dirty_sql('customer')} SELECT c_custkey, c_mktsegment IS NULL AS is_typo_c_mktsegment FROM dirty")
def own_reference(spark, sf_dir):
    bad = dirty(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return V.mask_typos(bad, R.default_reference(bad), "c_mktsegment").select("c_custkey", "is_typo_c_mktsegment")


@query("history_line", "SELECT iteration, impurity, fpr FROM (SELECT CAST(event_id % 7 AS INT) AS iteration, avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS impurity, avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS fpr FROM events GROUP BY 1)")
def history_line(spark, sf_dir):
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("int"))
    days = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 7).cast("int").alias("iteration")).agg(share("error").alias("impurity"), share("click").alias("fpr"))
    return sinks.history_chart(days)


@query(
    "changed_cell_styles",
    f"WITH {dirty_sql('customer')}, c AS (SELECT c_custkey, d.c_mktsegment AS a, coalesce(d.c_mktsegment, 'NONE') AS b FROM dirty d), x AS (SELECT * FROM c WHERE a IS DISTINCT FROM b) "
    "SELECT c_custkey AS row_id, 'c_mktsegment' AS column_name, a AS value, 'FFCCCC' AS colour FROM x UNION ALL SELECT c_custkey, 'c_mktsegment', b, 'CCFFCC' FROM x",
)
def changed_cell_styles(spark, sf_dir):
    bad = dirty(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    fixed = bad.withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("NONE")))
    errors, corrections = sinks.error_and_correction_styles(bad, fixed, "c_custkey")
    return errors.unionAll(corrections)


# --- columns and cells ---------------------------------------------------------------

KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "text"}


@query("column_kinds", union_sql([f"SELECT '{c}' AS column_name, '{k}' AS kind" for c, k in KINDS.items()]))
def column_kinds(spark, sf_dir):
    found = C.three_way_types(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c, k) for k, cols in zip(("text", "numeric", "date"), found, strict=True) for c in cols], "column_name string, kind string")


@query("shared_names", "SELECT 'n_name' AS column_name UNION ALL SELECT 'n_nationkey' UNION ALL SELECT 'n_regionkey'")
def shared_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(c,) for c in C.shared_columns(nation, nation.withColumn("other", F.lit(1)))], "column_name string")


@query("close_column_names", "SELECT 'Customer Name' AS column_name, 'customer_name' AS other UNION ALL SELECT 'adress', 'address'")
def close_column_names(spark, sf_dir):
    a = spark.createDataFrame([], "`Customer Name` string, adress string, id long, qqq string")
    return spark.createDataFrame(list(E.close_names(a, spark.createDataFrame([], "customer_name string, address string, id long")).items()), "column_name string, other string")


@query("fill_missing", f"WITH {dirty_sql('customer')} SELECT c_custkey, coalesce(c_mktsegment, 'MISSING') AS c_mktsegment, coalesce(c_acctbal, 0) AS c_acctbal FROM dirty")
def fill_missing(spark, sf_dir):
    return C.fill_numbers(C.fill_text(dirty(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")))


@query(
    "prepare_records",
    f"WITH {dirty_sql('orders')} SELECT o_orderkey, regexp_replace(lower(trim(coalesce(o_orderpriority, 'MISSING'))), '[^a-z0-9\\s]', '', 'g') AS normalized_o_orderpriority, "
    "CAST(coalesce(year(coalesce(try_strptime(o_day, '%Y-%m-%d'), try_strptime(o_day, '%d/%m/%Y'))), 0) AS INT) AS o_day_year, "
    "round((o_orderkey - avg(o_orderkey) OVER ()) / stddev_pop(o_orderkey) OVER (), 4) + 0.0::DOUBLE AS scaled FROM dirty",
)
def prepare_records(spark, sf_dir):
    out, _ = D.prepare(dirty(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], ["o_day"])
    return out.select("o_orderkey", "normalized_o_orderpriority", "o_day_year", (F.round("o_orderkey_scaled", 4) + 0.0).alias("scaled"))


@query(
    "feature_rows",
    f"WITH {dirty_sql('customer')}, f AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM dirty)) AS v FROM dirty) "
    "SELECT c_custkey, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 4) + 0.0::DOUBLE AS scaled, 1 AS categories FROM f",
)
def feature_rows(spark, sf_dir):
    out = C.feature_matrix(dirty(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal"], ["c_mktsegment"]).withColumn("x", vector_to_array("features"))
    ones = F.size(F.filter(F.slice("x", 2, 100), lambda v: v == 1.0))
    return out.select("c_custkey", (F.round(F.col("x")[0], 4) + 0.0).alias("scaled"), ones.alias("categories"))


@query("change_preview", f"WITH {dirty_sql('customer')} SELECT c.c_custkey, c.c_mktsegment AS c_mktsegment_before, d.c_mktsegment AS c_mktsegment_after FROM customer c JOIN dirty d USING (c_custkey) ORDER BY c_custkey LIMIT 5")
def change_preview(spark, sf_dir):
    return C.preview_change(table(spark, sf_dir, "customer"), dirty(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"])


@query("clean_texts", f"WITH {dirty_sql('part')} SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(coalesce(p_name, ''), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g'))) AS p_name FROM dirty")
def clean_texts(spark, sf_dir):
    return dirty(spark, sf_dir, "part").select("p_partkey", T.clean_text(F.col("p_name")).alias("p_name"))


@query(
    "company_rules",
    f"WITH {dirty_sql('customer')} SELECT 'CompanyName' AS column_name, count(*) AS n FROM dirty WHERE NOT regexp_full_match(c_name, '[^\\s][A-Za-z0-9\\s\\-()]*[^\\s]') "
    "UNION ALL SELECT 'CompanyCategory', count(*) FROM dirty WHERE NOT regexp_full_match(upper(c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END), '[^\\s][A-Za-z0-9/\\s\\-,()'']*[^\\s]')",
)
def company_rules(spark, sf_dir):
    padded = F.upper(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise("")))
    rows = dirty(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("CompanyName"), padded.alias("CompanyCategory"))
    return V.summarize_invalid(V.invalid_entries(rows, P.COMPANY_RULES, "c_custkey"))


@query("pattern_tools", "SELECT 'joined' AS what, '([0-9]+|[a-z]+)' AS value UNION ALL SELECT 'one', '[a-z]+' UNION ALL SELECT 'none', '.*' UNION ALL SELECT 'dialect', '(?<a>x)\\z' UNION ALL SELECT 'checked', '[0-9]'")
def pattern_tools(spark, sf_dir):
    rows = [("joined", P.combine(["[a-z]+", "[0-9]+", "(", "[a-z]+"])), ("one", P.combine(["[a-z]+", "["])), ("none", P.combine(["("])), ("dialect", P.to_java(r"(?P<a>x)\Z")), ("checked", P.check_patterns({"a": "[0-9]"})["a"])]
    return spark.createDataFrame(rows, "what string, value string")


@query("unicode_words", "SELECT doc_id, regexp_full_match(split_part(text, ' ', 1), '[\\p{L}\\p{N}_]+') AS word FROM documents WHERE text IS NOT NULL")
def unicode_words(spark, sf_dir):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.matches(first, r"\w+", unicode=True).alias("word"))


@query("sampled_patterns", union_sql([f"SELECT '{c}' AS column_name, min(p) AS pattern FROM (SELECT {class_sql('v')} AS p FROM (SELECT CAST({c} AS STRING) AS v FROM customer))" for c in ("c_custkey", "c_name")]))
def sampled_patterns(spark, sf_dir):
    return A.infer_patterns(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"], sample_size=100)


@query("good_pairs", f"WITH {M.WINDOW} SELECT record1, record2 FROM pairs WHERE score >= 60")
def good_pairs(spark, sf_dir):
    return V.at_least(M._window_pairs(spark, sf_dir), "score", 60).select("record1", "record2")


@query("duplicate_records", f"WITH q AS ({M._classes_sql('max')}) SELECT p_partkey FROM q WHERE record_class = 2")
def duplicate_records(spark, sf_dir):
    return V.of_class(M.record_classes(spark, sf_dir), 2).select("p_partkey")


# --- similarity ----------------------------------------------------------------------


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence of two texts of under 120 characters, by bit rows."""
    mask = f"((1::HUGEINT << CAST(length({a}) AS INT)) - 1)"
    places = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::HUGEINT << CAST(i - 1 AS INT) ELSE 0::HUGEINT END))"
    rows = f"list_transform(string_split({b}, ''), lambda ch: CAST({places} AS HUGEINT))"
    return f"(length({a}) - bit_count(list_reduce({rows}, lambda r, p: ((r + (r & p)) | (r - (r & p))) & {mask}, {mask})))"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE round_even(200.0::DOUBLE * {lcs_sql(a, b)} / (length({a}) + length({b})), 0) END"


@query("edit_ratios", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST({ratio_sql('a.n_name', 'b.n_name')} AS DOUBLE) AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def edit_ratios(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(s), F.col("n_name").alias(f"{s}_name")) for s in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", T.similarity(F.col("a_name"), F.col("b_name"), "edit").alias("score"))


_OWN = "array_to_string(list_sort(list_filter({x}, lambda w: NOT list_contains({y}, w))), ' ')"
_SETS = (
    "named AS (SELECT n_nationkey, concat(n_name, ' ', CASE n_regionkey % 3 WHEN 0 THEN 'trade co' WHEN 1 THEN 'Trade & Sons co' ELSE 'sea trade' END) AS t FROM nation), "
    "worded AS (SELECT n_nationkey, list_distinct(list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS w FROM named), "
    "pairs AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.w AS x, b.w AS y, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS both_ FROM worded a JOIN worded b ON a.n_nationkey < b.n_nationkey), "
    f"sides AS (SELECT a, b, both_, trim(concat(both_, ' ', {_OWN.format(x='x', y='y')})) AS l, trim(concat(both_, ' ', {_OWN.format(x='y', y='x')})) AS r FROM pairs)"
)


@query("word_set_ratios", f"WITH {_SETS} SELECT a, b, CAST(greatest({ratio_sql('both_', 'l')}, {ratio_sql('both_', 'r')}, {ratio_sql('l', 'r')}) AS DOUBLE) AS score FROM sides")
def word_set_ratios(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    tail = F.when(F.col("n_regionkey") % 3 == 0, "trade co").when(F.col("n_regionkey") % 3 == 1, "Trade & Sons co").otherwise("sea trade")
    a, b = (n.select(F.col("n_nationkey").alias(s), F.concat_ws(" ", "n_name", tail).alias(f"{s}_name")) for s in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", T.similarity(F.col("a_name"), F.col("b_name"), "token_set").alias("score"))


@query("no_vocabulary", "SELECT doc_id AS row_id, 0.0::DOUBLE AS mean_cosine FROM documents")
def no_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("! ?").alias("text"))
    return D.mean_cosine(docs, D.tfidf(docs, F.col("text"), "doc_id"), "doc_id")


# --- entity resolution ---------------------------------------------------------------


@query("link_first_ten", f"WITH {M._LINKED} SELECT row_1, row_2, round(s, 6) AS text_similarity FROM link WHERE row_1 IN (SELECT row_id FROM base ORDER BY row_id LIMIT 10)")
def link_first_ten(spark, sf_dir):
    out = E.link(*M._sides(spark, sf_dir), max_matches=10)
    return out.select("row_1", "row_2", F.round("text_similarity", 6).alias("text_similarity"))


@query(
    "merge_matched_only",
    f"WITH base AS ({M.BASE}), incoming AS ({M.INCOMING}), m AS ({M._MATCHED}) SELECT {M._golden('b.name', 'name')}, {M._golden('b.place', 'place')}, "
    "row_1, row_2, CAST(final_similarity AS DOUBLE) AS final_similarity, 'base + incoming' AS source_chain FROM m JOIN base b ON b.row_id = row_1 JOIN incoming i ON i.row_id = row_2",
)
def merge_matched_only(spark, sf_dir):
    base, incoming = M._sides(spark, sf_dir)
    matches = spark.sql(M._MATCHED).withColumn("final_similarity", F.col("final_similarity").cast("double"))
    return E.merge(matches, base, incoming, keep_unmatched=False)


PLACED = "SELECT s_suppkey, s_nationkey AS n, s_acctbal AS b FROM supplier"


@query(
    "row_errors",
    f"WITH t AS ({PLACED}), s AS (SELECT s_suppkey, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS x, (n - min(n) OVER ())::DOUBLE / (max(n) OVER () - min(n) OVER ()) AS y FROM t), "
    "m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM s), a AS (SELECT *, 0.5::DOUBLE * atan2(2 * c, vx - vy) AS w FROM m) "
    "SELECT s_suppkey AS row_id, round(pow((x - mx) * sin(w) - (y - my) * cos(w), 2) / 2, 6) AS error FROM s, a",
)
def row_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return E.row_errors(rows, rows, ["s_acctbal", "s_nationkey"], "s_suppkey", 1).select("row_id", F.round("error", 6).alias("error"))


def _formatted(c: str, lower: str, bare: str) -> str:
    cased = f"CASE WHEN {lower} THEN lower({c}) ELSE {c} END"
    plain = f"CASE WHEN {bare} THEN regexp_replace({cased}, '[^\\w\\s]', '', 'g') ELSE {cased} END"
    return f"regexp_replace({plain}, '(?i)\\bco\\b', 'company', 'g') AS {c}"


def _first_rows(source: str, c: str) -> tuple[str, str]:
    first = f"(SELECT * FROM {source} ORDER BY p_partkey LIMIT 20)"
    return f"(SELECT coalesce(bool_and({LOWER.format(c=c)}), true) FROM {first})", f"(SELECT coalesce(bool_and(NOT {PUNCTUATED.format(c=c)}), true) FROM {first})"


def _majority(source: str, c: str) -> tuple[str, str]:
    return f"coalesce((SELECT avg(CAST({LOWER.format(c=c)} AS INT)) > 0.6 FROM {source}), false)", f"coalesce((SELECT avg(CAST({PUNCTUATED.format(c=c)} AS INT)) < 0.4 FROM {source}), false)"


def _standardized(spark, sf_dir, mode, **options):
    pick = lambda d: d.select("p_partkey", "p_name", "p_type")
    sets = [("dirty", pick(dirty(spark, sf_dir, "part"))), ("clean", pick(table(spark, sf_dir, "part")))]
    return E.standardize(sets, mode, abbreviations={"co": "company"}, row_id="p_partkey", **options)[0][1]


@query("standardize_by_table", f"WITH {dirty_sql('part')} SELECT p_partkey, {_formatted('p_name', *_first_rows('part', 'p_name'))}, {_formatted('p_type', *_first_rows('part', 'p_type'))} FROM dirty")
def standardize_by_table(spark, sf_dir):
    return _standardized(spark, sf_dir, "standard", standard="clean")


@query("standardize_by_column", f"WITH {dirty_sql('part')} SELECT p_partkey, {_formatted('p_name', *_first_rows('dirty', 'p_name'))}, {_formatted('p_type', *_first_rows('part', 'p_type'))} FROM dirty")
def standardize_by_column(spark, sf_dir):
    return _standardized(spark, sf_dir, "column", sources={"p_name": "dirty", "p_type": "clean"})


@query("standardize_each", f"WITH {dirty_sql('part')} SELECT p_partkey, {_formatted('p_name', *_majority('dirty', 'p_name'))}, {_formatted('p_type', *_majority('dirty', 'p_type'))} FROM dirty")
def standardize_each(spark, sf_dir):
    return _standardized(spark, sf_dir, "majority", per_dataset=True)


@query("standardize_by_rules", f"WITH {dirty_sql('part')} SELECT p_partkey, regexp_replace(lower(p_name), '[^\\w\\s]', '', 'g') AS p_name, regexp_replace(p_type, '[^\\d.]', '', 'g') AS p_type FROM dirty")
def standardize_by_rules(spark, sf_dir):
    return _standardized(spark, sf_dir, "rules", rules={"p_name": {"lower": True, "punctuation": True}, "p_type": {"currency": True}})


# --- learning, by what must hold -----------------------------------------------------

_CLASSES = f"q AS ({M._classes_sql('max')})"


@query("split_shares", f"WITH {_CLASSES} SELECT record_class, count(*) AS n, true AS apart, true AS share FROM q GROUP BY record_class")
def split_shares(spark, sf_dir):
    rows = M.record_classes(spark, sf_dir)
    train, test = L.stratified_split(rows, "record_class", "p_partkey")
    both = train.withColumn("t", F.lit(1)).unionAll(test.withColumn("t", F.lit(0)))
    found = both.groupBy("record_class").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("d"), F.sum("t").alias("t"))
    return found.select("record_class", "n", (F.col("n") == F.col("d")).alias("apart"), (F.abs(F.col("t") - 0.7 * F.col("n")) <= 1 + 0.01 * F.col("n")).alias("share"))


@query("level_classes", f"WITH {_CLASSES}, c AS (SELECT record_class, count(*) AS n FROM q GROUP BY record_class) SELECT record_class, (SELECT max(n) FROM c) AS n, true AS inside FROM c WHERE (SELECT min(n) FROM c) >= 2")
def level_classes(spark, sf_dir):
    rows = D.classify(M._parts(spark, sf_dir), M._window_pairs(spark, sf_dir), "p_partkey").select(F.col("p_partkey").alias("row_id"), "record_class", "p_size", "p_retailprice")
    ready = VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="features").transform(rows).select("row_id", "record_class", "features")
    level = L.oversample(ready, "record_class").select("record_class", vector_to_array("features").alias("x"))
    ends = rows.groupBy("record_class").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    inside = level.join(ends, "record_class").withColumn("in", F.col("x")[0].between(F.col("lo") - 1e-9, F.col("hi") + 1e-9))
    return inside.groupBy("record_class").agg(F.count("*").alias("n"), F.bool_and("in").alias("inside"))


@query(
    "classifier_scores",
    "WITH flags AS (SELECT o_orderstatus AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'O' ELSE o_orderstatus END AS p FROM orders), c AS (SELECT t, p, count(*) AS n FROM flags GROUP BY t, p), "
    "k AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE t = label AND p = label) AS hit, (SELECT coalesce(sum(n), 0) FROM c WHERE p = label) AS said, (SELECT coalesce(sum(n), 0) FROM c WHERE t = label) AS support FROM (SELECT DISTINCT t AS label FROM c)), "
    "m AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re FROM k), f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM m) "
    "SELECT round(sum(hit) / sum(support), 4)::DOUBLE AS accuracy, round(sum(pr * support) / sum(support), 4)::DOUBLE AS precision, round(sum(re * support) / sum(support), 4)::DOUBLE AS recall, round(sum(f1 * support) / sum(support), 4)::DOUBLE AS f1 FROM f",
)
def classifier_scores(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("t"), F.when(F.col("o_orderkey") % 5 == 0, "O").otherwise(F.col("o_orderstatus")).alias("p"))
    return spark.createDataFrame([S.classifier_scores(pairs, "t", "p")], "accuracy double, precision double, recall double, f1 double")


@query("cluster_facts", "SELECT count(*) AS rows, 5::BIGINT AS clusters, 0::BIGINT AS unplaced, count(*) AS known, 25::BIGINT AS samples FROM part")
def cluster_facts(spark, sf_dir):
    rows = D.classify(M._parts(spark, sf_dir), M._window_pairs(spark, sf_dir), "p_partkey")
    found = L.analyze_clusters(L.cluster_records(rows, F.concat_ws(" ", *M.TEXT), M.NUMERIC, "p_partkey"), row_id="p_partkey")
    known = F.col("duplicates") + F.col("similar") + F.col("unique")
    return found.agg(F.sum("size").alias("rows"), F.count("*").alias("clusters"), F.count_if(F.col("mean_centroid_distance").isNull() | (F.col("mean_centroid_distance") < 0)).alias("unplaced"), F.sum(known).alias("known"), F.sum(F.size("samples")).cast("long").alias("samples"))


@query("synthetic_facts", f"SELECT 500::BIGINT AS rows, 0::BIGINT AS wrong_codes, 0::BIGINT AS wrong_words, (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS segment, {sql_text(G.FALLBACK)} AS other, true AS near")
def synthetic_facts(spark, sf_dir):
    metrics = A.collect_profile(A.profile(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"]))
    out = G.synthesize(spark, metrics, {"code": r"^\d+$", "word": r"^[A-Za-z\s]+$", "else": "x"}, 500, digits=None)
    m = metrics["c_acctbal"]
    return out.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("code").rlike(r"^[1-9]\d{3}$")).alias("wrong_codes"),
        F.count_if(~F.col("word").isin(*G.WORDS)).alias("wrong_words"),
        F.max("c_mktsegment").alias("segment"),
        F.max("else").alias("other"),
        (F.abs(F.avg("c_acctbal") - m["mean"]) < 6 * m["std"] / 500**0.5).alias("near"),
    )
