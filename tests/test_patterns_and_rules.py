import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.operators import profile as A
from tidemark.operators import repair as R
from tidemark.operators import validate as V
from tidemark.operators.rules import Bounds, Custom, Format, clip, compile_rules, constrained

CLEAN = [("101", "2023-01-01", "C001", "100.50", "credit", "Purchase of electronics"), ("102", "2023-01-02", "C002", "20.00", "debit", "Groceries")]
UNCLEAN = [
    ("101", "2023-01-01", "C001", "100.50", "credit", "Purchase"),
    ("102", "MISSING", "C002", "INVALID", "debit", ""),
    ("", "2023-01-03", "C003", "1.00", "MISSING", "1234"),
    ("INVALID", "2023-01-04", "C004", "2.00", "debit", "Books"),
]
COLUMNS = ["TransactionID", "TransactionDate", "CustomerID", "Amount", "PaymentMethod", "Description"]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["row_id", *COLUMNS])


def test_inferred_patterns(spark):
    found = A.collect_patterns(A.infer_patterns(frame(spark, CLEAN), COLUMNS))
    assert found == {
        "TransactionID": r"^\d+$",
        "TransactionDate": r"^\d{4}-\d{2}-\d{2}$",
        "CustomerID": r"^[A-Za-z0-9\s]+$",
        "Amount": r"^\d+\.\d+$",
        "PaymentMethod": r"^[A-Za-z\s]+$",
        "Description": r"^[A-Za-z\s]+$",
    }


def test_invalid_cells_and_blanks(spark):
    rules = A.collect_patterns(A.infer_patterns(frame(spark, CLEAN), COLUMNS))
    bad = {(r.row_id, r.column_name, r.value) for r in V.invalid_entries(frame(spark, UNCLEAN), rules).collect()}
    assert bad == {(1, "TransactionDate", "MISSING"), (1, "Amount", "INVALID"), (1, "Description", ""), (2, "TransactionID", ""), (2, "Description", "1234"), (3, "TransactionID", "INVALID")}
    marked = R.mark_issues(frame(spark, UNCLEAN), compile_rules(rules)).orderBy("row_id").collect()
    assert (marked[1].Description, marked[2].TransactionID, marked[2].Description, marked[2].PaymentMethod) == ("MISSING", "MISSING", "INVALID", "MISSING")


def test_marking_checks_both_columns(spark):
    df = spark.createDataFrame([("123", "2023-01-01"), ("abc", "INVALID"), ("456", "2023-01-02")], "Column1 string, Column2 string")
    out = R.mark_issues(df, compile_rules({"Column1": r"^\d+$", "Column2": r"^\d{4}-\d{2}-\d{2}$"})).collect()
    assert [tuple(r) for r in out] == [("123", "2023-01-01"), ("INVALID", "INVALID"), ("456", "2023-01-02")]
    share = {r.column_name: r.valid_percentage for r in A.valid_percentages(df, {"Column1": r"^\d+$"}).collect()}
    assert abs(share["Column1"] - 200 / 3) < 1e-9


@pytest.mark.parametrize("ruleset", [1, 2])
def test_classes_equal_trial_in_order(spark, ruleset):
    values = ["1", "1.5", "-1.5", "2023-01-01", "01/02/2023", "10:30", "10:30:05", "a b", "a1 b", "a,b.c-d", "a_b-c", "GU1 4RY", "GU14RY", "é", "", "5\n", "x@y", "a/b", "(a)", "'q'", "!!!", "http://business.data.gov.uk/id/company/0123"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.p for r in df.select("v", P.value_class(F.col("v"), ruleset).alias("p")).collect()}
    for v in values:
        want = next((p for t, p in P.RULESETS[ruleset] if re.fullmatch(t, v, re.ASCII)), ".*")
        assert got[v] == want, v


def test_full_and_prefix_matching(spark):
    df = spark.createDataFrame([("X1",), ("a",), ("1",), ("5\n",), ("12",)], "v string")
    full = [r[0] for r in df.select(P.matches(F.col("v"), r"^a|1$")).collect()]
    assert full == [False, True, True, False, False]
    assert [r[0] for r in df.select(P.matches(F.col("v"), r"^\d+$")).collect()] == [False, False, True, False, True]
    assert [r[0] for r in df.select(P.matches(F.col("v"), r"\d", "prefix")).collect()] == [False, False, True, True, True]
    assert P.to_java(r"(?P<x>a)\Z") == r"(?<x>a)\z"


def test_pattern_helpers():
    assert P.combine([r"^\d+$", "(", r"^[a-z]+$"]) == r"(^[a-z]+$|^\d+$)"
    assert P.combine([]) == ".*" and P.combine(["("]) == ".*" and P.combine(["a", "a"]) == "a"
    assert P.is_valid_regex(re.compile("a")) and not P.is_valid_regex("(") and not P.is_valid_regex(3)
    with pytest.raises(TypeError):
        P.check_patterns({"a": 3})
    assert len(P.COMPANY_RULES) == 54


def test_corrected_company_rules_accept_the_sample(spark):
    rules = P.corrected_company_rules()
    good = {"RegAddress.PostCode": "GU1 4RY", "IncorporationDate": "12/10/2022", "CompanyNumber": "14413082", "CompanyStatus": "Active", "DissolutionDate": "", "CompanyName": "HEAL UR TECH LTD"}
    df = spark.createDataFrame([tuple(good.values())], list(good))
    assert V.invalid_entries(df.withColumn("row_id", F.lit(1)), {c: rules[c] for c in good}).count() == 0
    assert V.invalid_entries(df.withColumn("row_id", F.lit(1)), {c: P.COMPANY_RULES[c] for c in good}).count() >= 2


def test_compile_rules_errors_and_kinds():
    rules = compile_rules({"a": r"^\d+$", "b": "x"}, {"b": {"min": 1, "max": 9, "mode": "m"}, "absent": {"min": 1}})
    assert rules == {"a": Format(r"^\d+$"), "b": Bounds(1, 9, "m")}
    with pytest.raises(TypeError):
        compile_rules({"a": "x"}, {"a": 5})
    with pytest.raises(ValueError):
        compile_rules({"a": "("})


def test_bounds_custom_and_clip(spark):
    df = spark.createDataFrame([("5",), ("50",), ("x",), ("m",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(constrained(F.col("v"), 10, 20, "m")).collect()] == ["10", "20", "m", "m", None, "20"]
    assert [r[0] for r in df.select(Custom(lambda c: F.when(c != "x", F.upper(c))).apply(F.col("v"))).collect()][:3] == ["5", "50", "INVALID"]
    n = spark.createDataFrame([(1.0,), (None,), (9.0,)], "v double")
    assert [r[0] for r in n.select(clip(F.col("v"), 2.0, None)).collect()] == [2.0, None, 9.0]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "", "y")], "row_id int, `A.b` string, `C.d` string")
    assert {(r.column_name, r.missing) for r in A.missing_counts(df, ["A.b", "C.d"]).collect()} == {("A.b", 1), ("C.d", 1)}
    assert R.mark_missing(df).orderBy("row_id").collect()[0][2] == "MISSING"
    assert A.profile(df).count() == 3


def test_profile_of_nothing(spark):
    out = {r.column_name: r for r in A.profile(spark.createDataFrame([], "a int, b string")).collect()}
    assert out["a"].unique_ratio == 0 and out["a"].completeness_ratio is None and out["b"].mode is None and out["b"].entropy == 0
    one = {r.column_name: r for r in A.profile(spark.createDataFrame([(1, None)], "a int, b string")).collect()}
    assert one["a"].std is None and one["a"].mean == 1 and one["b"].completeness_ratio == 0


def test_constraints_from_history():
    got = A.suggest_constraints({"a": {"mean": -10.0, "mode": "x"}})
    assert got["a"]["mean"]["min"] == pytest.approx(-11) and got["a"]["mean"]["max"] == pytest.approx(-9) and got["a"]["mode"] == "x"


def test_sampled_patterns(spark):
    df = spark.createDataFrame([(str(i),) for i in range(500)], "v string")
    assert A.collect_patterns(A.infer_patterns(df, sample_size=100)) == {"v": r"^\d+$"}
    assert A.collect_patterns(A.infer_patterns(spark.createDataFrame([(None,)], "v string"))) == {"v": ".*"}


def test_duplicate_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, None), (5, "a", None)], "row_id int, p string, q string")
    assert sorted(r.row_id for r in A.duplicate_rows(df, "row_id").collect()) == [2, 5]
