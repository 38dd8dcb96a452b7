"""Every registered query with SQL against DuckDB, and the layout of the package."""

import math
import os
import pathlib

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if type(x).__name__ == "Decimal":
        return round(float(x), 5)
    return x


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["fuzzy_pairs", "resolve_all", "synthetic_rows"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tidemark").parts:
            assert "tidemark.llm" not in path.read_text(), path


def test_plans_read_only_what_they_need(spark):
    if not os.path.isdir(DATA):
        pytest.skip("needs the driver's tables")
    plan = QUERIES["constraint_violations"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in plan and "Python" not in plan
    marked = QUERIES["mark_issues"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in marked and "Python" not in marked
