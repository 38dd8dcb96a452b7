"""Registering queries, and the tables with planted errors that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.patterns import RULESETS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Missing values, typos and outliers, by expressions that Spark and DuckDB read alike.
DIRTY = {
    "customer": {
        "c_custkey": "c_custkey",
        "c_name": "CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN concat(' ', c_name, ' ') ELSE c_name END",
        "c_nationkey": "c_nationkey",
        "c_acctbal": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN c_acctbal * 100 ELSE c_acctbal END",
        "c_mktsegment": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN concat(c_mktsegment, 'X') ELSE c_mktsegment END",
    },
    "orders": {
        "o_orderkey": "o_orderkey",
        "o_orderstatus": "CASE WHEN o_orderkey % 13 = 0 THEN '9' ELSE o_orderstatus END",
        "o_orderpriority": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat('?', o_orderpriority) ELSE o_orderpriority END",
        "o_day": "CASE WHEN o_orderkey % 17 = 0 THEN '03/10/1998' WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    },
    "part": {
        "p_partkey": "p_partkey",
        "p_name": "CASE WHEN p_partkey % 5 = 0 THEN concat(upper(p_name), ' (new)!') WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END",
        "p_brand": "CASE WHEN p_partkey % 9 = 0 THEN concat('$', p_brand, '.50') ELSE p_brand END",
        "p_type": "CASE WHEN p_partkey % 8 = 0 THEN concat(p_type, ' co ltd') ELSE p_type END",
        "p_size": "p_size",
        "p_retailprice": "p_retailprice",
    },
}


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in DIRTY[name].items()])


def dirty_sql(name: str) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in DIRTY[name].items())
    return f"dirty AS (SELECT {cols} FROM {name})"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def class_sql(value: str, ruleset: int = 1) -> str:
    """The format class of a text value."""
    whens = " ".join(f"WHEN regexp_full_match({value}, {sql_text(t)}) THEN {sql_text(p)}" for t, p in RULESETS[ruleset])
    return f"CASE {whens} ELSE '.*' END"


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
