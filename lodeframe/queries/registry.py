"""Queries by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans.compile import compile_plan
from lodeframe.plans.relations import Read, Relation
from lodeframe.plans.rules import Optimizer

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Declared unique keys of the tables.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",)}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a directory, as the compiler wants them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def read(table: str, *columns: str) -> Read:
    return Read(table, columns)


def run(spark: SparkSession, sf_dir: str, plan: Relation, names: tuple = (), optimize=True) -> DataFrame:
    if optimize:
        plan = Optimizer(("constant_folding", "projection_pushdown", "expression_extraction"))(plan)
    df = compile_plan(plan, Tables(spark, sf_dir))
    return df.toDF(*names) if names else df


def plan_query(name: str, plan: Relation, names: tuple, sql: str | None) -> None:
    """A query that is a logical plan; ``names`` are those of its output."""
    add(name, lambda spark, sf_dir: run(spark, sf_dir, plan, names), sql)


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL over the directory's tables, which are given as {table}."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if "{" + t + "}" in text]
        return spark.sql(text, **{t: Tables(spark, sf_dir)(t) for t in used})

    plain = text
    for t in TABLES:
        plain = plain.replace("{" + t + "}", t)
    add(name, query, oracle or plain)


def add(name: str, query, sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql
