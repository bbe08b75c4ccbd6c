"""Zoned tables, appends, jobs and scalar functions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.expressions import Lit, Ref
from lodeframe.plans import relations as R
from lodeframe.session import Engine
from lodeframe.sources import parquet as P
from lodeframe.sources.shared import scope, shared_dir, written

SF = "/root/testdata/sf0.01"


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = 0, [plan]
    while todo:
        p = todo.pop()
        metrics = p.metrics()
        if metrics.contains("numFiles"):
            out += metrics.apply("numFiles").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_only_zones_that_may_hold_rows_are_read(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").unionByName(spark.createDataFrame([(None, 7, 1.0)], "o_orderkey int, o_custkey int, o_totalprice double"))
    P.write_zoned(df, str(tmp_path / "t"), "o_orderkey", 20)
    everything = P.read_zoned(spark, str(tmp_path / "t"))
    assert files_read(everything) >= 20 and everything.count() == df.count() and everything.columns == df.columns
    few = P.read_zoned(spark, str(tmp_path / "t"), (Ref(0) >= 3000) & (Ref(0) < 3500))
    assert 1 <= files_read(few) <= 3
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, df.where("o_orderkey >= 3000 AND o_orderkey < 3500").collect()))
    none = P.read_zoned(spark, str(tmp_path / "t"), Ref(0) > 10**8)
    assert none.collect() == [] and files_read(none) == 0
    other = P.read_zoned(spark, str(tmp_path / "t"), ~(Ref(1).eq(Lit(7))))  # says nothing of a zone
    assert other.count() == df.where("o_custkey <> 7").count()
    with pytest.raises(ValueError):
        P.write_zoned(df, str(tmp_path / "u"), "o_orderkey", 0)


def test_a_zoned_table_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    P.write_zoned(df, str(tmp_path / "t"), "k", 3)
    assert sorted(r.x for r in P.read_zoned(spark, str(tmp_path / "t")).collect()) == ["a", "b"]


def test_appends_keep_only_what_is_new(spark):
    engine = Engine(spark)
    engine.run_script("DROP TABLE IF EXISTS grown; CREATE TABLE grown (k INTEGER, x VARCHAR)")
    seen = []
    for i in range(4):
        rows = spark.createDataFrame([(i, "a"), (i + 10, "b")], "k int, x string").withColumn("x", F.concat("x", F.lit("")))
        assert engine.catalog.append("grown", rows) == 2
        seen.append(engine.catalog.table("grown").parts[-1])
    assert len({id(p) for p in seen}) == 4 and all(p.storageLevel.useMemory for p in seen)
    assert engine.sql("SELECT count(*) AS n, count(DISTINCT k) AS m FROM grown").first()[:] == (8, 8)
    assert engine.catalog.table("grown").rows == 8
    parts = engine.catalog.table("grown").parts
    engine.sql("DROP TABLE grown")
    assert not any(p.storageLevel.useMemory for p in parts)


def test_appended_files_count_what_was_written(spark, tmp_path):
    engine = Engine(spark)
    engine.run_script(f"DROP TABLE IF EXISTS grown_files; CREATE EXTERNAL TABLE grown_files (k INTEGER) STORED AS PARQUET LOCATION '{tmp_path}/t'")
    for n in (3, 0, 5):
        assert engine.catalog.append("grown_files", spark.range(n).select(F.col("id").cast("int"))) == n
    assert engine.sql("SELECT * FROM grown_files").count() == 8 == engine.catalog.table("grown_files").rows


def test_jobs(spark, tmp_path):
    job = {"sql": "SELECT count(*) AS n FROM job_table", "tables": {"job_table": {"directory": f"{SF}/nation.parquet"}}, "output": str(tmp_path / "out")}
    (tmp_path / "job.json").write_text(json.dumps(job))
    assert Engine(spark).run_job(str(tmp_path / "job.json")).first().n == 25
    assert spark.read.parquet(str(tmp_path / "out")).first().n == 25
    for wrong in ({"sql": ""}, {"tables": {}}, {"sql": "SELECT 1", "more": 1}, {"sql": "SELECT 1", "tables": {"t": {"file": "a", "directory": "b"}}}, {"sql": "SELECT 1", "tables": {"t": {}}}):
        with pytest.raises(ValueError):
            Engine(spark).run_job(wrong)


def test_scalar_functions(spark):
    engine = Engine(spark)
    engine.register_function("lode_twice", lambda x: x * 2, "double")
    assert engine.sql("SELECT lode_twice(21) AS v").first().v == 42.0


def test_a_scope_leaves_no_tables(spark):
    base = Path(shared_dir(spark).removeprefix("file://"))
    before = set(base.iterdir()) if base.exists() else set()
    with scope(spark):
        kept = written(spark.range(5), "kept")
        with scope(spark):
            written(spark.range(3), "inner")
        assert kept.count() == 5 and len(set(base.iterdir()) - before) == 1
    assert set(base.iterdir()) == before


def test_plans_over_zoned_tables_read_few_files(spark, tmp_path):
    P.write_zoned(spark.read.parquet(f"{SF}/orders.parquet"), str(tmp_path / "t"), "o_orderkey", 20)
    engine = Engine(spark)
    engine.catalog.register_zoned("zoned_t", str(tmp_path / "t"), unique_keys=[("o_orderkey",)])
    plan = R.Filter(R.Read("zoned_t", ("o_orderkey", "o_totalprice")), (Ref(0) >= 3000) & (Ref(0) < 3500))
    counts = {}
    for way in ("false", "true"):
        engine.sql(f"SET use_partition_pruning = {way}")
        df = engine.run_plan(plan)
        counts[way] = files_read(df)
        assert sorted(r[0] for r in df.collect()) == list(range(3000, 3500))
    assert counts["true"] <= 3 and counts["false"] >= 20
    assert engine.sql("SELECT count(*) AS n FROM zoned_t").first().n == 15000
    spark.conf.unset("spark.sql.inMemoryColumnarStorage.partitionPruning")
