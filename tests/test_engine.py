"""SQL statements, scripts, DDL, COPY, options, snapshots, plan files and Parquet pruning."""

import json

import pytest

from lodeframe.functions import expressions as E
from lodeframe.functions.expressions import Lit, Ref
from lodeframe.plans import relations as R
from lodeframe.session import Engine, split_script
from lodeframe.sources import parquet as P
from lodeframe.sources.options import DEFAULTS

REGION = "/root/testdata/sf0.001/region.parquet"


@pytest.fixture
def engine(spark):
    return Engine(spark)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_create_copy_append_and_query(engine):
    engine.sql("CREATE TABLE t_region (r_regionkey INTEGER NOT NULL, r_name VARCHAR(25) NOT NULL)")
    assert values(engine.sql("SELECT count(*) FROM t_region")) == [(0,)]
    for n in (5, 10):
        assert values(engine.sql(f"COPY t_region FROM '{REGION}' (FORMAT parquet)")) == [(5,)]
        assert values(engine.sql("SELECT count(*) FROM t_region")) == [(n,)]
    assert values(engine.sql("SELECT count(*) FROM t_region WHERE r_name = 'ASIA'")) == [(2,)]
    assert values(engine.catalog.tables().select("table_name", "row_count")) == [("t_region", 10)]
    with pytest.raises(ValueError):
        engine.sql(f"COPY t_region FROM '{REGION}' (FORMAT csv)")
    engine.sql("DROP TABLE t_region")
    with pytest.raises(Exception):
        engine.sql("SELECT * FROM t_region").collect()


def test_drop_and_replace(engine):
    engine.sql("DROP TABLE IF EXISTS nothing")
    with pytest.raises(KeyError):
        engine.sql("DROP TABLE nothing")
    engine.sql("CREATE TABLE t_rep (id INTEGER NOT NULL)")
    with pytest.raises(ValueError):
        engine.sql("CREATE TABLE t_rep (id INTEGER)")
    engine.sql("CREATE OR REPLACE TABLE t_rep (id INTEGER NOT NULL, name VARCHAR NOT NULL)")
    assert engine.catalog.table("T_REP").columns == ["id", "name"]


@pytest.mark.parametrize(
    "columns,keys",
    [
        ("id BIGINT NOT NULL UNIQUE, v BIGINT NOT NULL", [("id",)]),
        ("id BIGINT PRIMARY KEY NOT NULL, v BIGINT", [("id",)]),
        ("a BIGINT, b BIGINT, PRIMARY KEY (a)", [("a",)]),
        ("a BIGINT, b BIGINT, c BIGINT, PRIMARY KEY (b, a)", [("a", "b")]),
        ("a BIGINT, b BIGINT UNIQUE, c DOUBLE PRECISION, UNIQUE (a, c)", [("b",), ("a", "c")]),
    ],
)
def test_constraints(engine, columns, keys):
    engine.sql(f"CREATE TABLE t_keys ({columns})")
    assert engine.catalog.table("t_keys").unique_keys == keys


@pytest.mark.parametrize(
    "options",
    ["storage_kind = 'boost_shared_memory'", "storage_kind = 'system_memory'", "storage_kind = 'PINNED_MEMORY'", "storage_kind = 'managed_memory'", "storage_kind = 'device_memory', device_id = 0", "storage_kind = 'numa_pool_memory', numa_node_id = 0", "storage_kind = 'shared_numa_pool_memory'", "storage_kind = 'numa_memory', numa_node_set = ARRAY[0, 1], page_kind = 'huge2mb'", "storage_kind = 'numa_pinned_memory'"],
)
def test_storage_kinds(engine, options):
    engine.sql(f"CREATE TABLE t_kind (x BIGINT NOT NULL) WITH ({options})")
    assert values(engine.sql("SELECT * FROM t_kind")) == []


@pytest.mark.parametrize(
    "tail",
    ["WITH (storage_kind = 'floppy')", "WITH (storage_kind = 'system_memory', device_id = 0)", "WITH (storage_kind = 'device_memory', device_id = '3')", "WITH (storage_kind = 'device_memory', device_id = -1)", "WITH (storage_kind = 'numa_memory', page_kind = 'tiny')", "WITH (storage_kind = 'numa_memory', numa_node_set = 1)", "WITH (storage_kind = 'parquet_file')", "WITH (storage_kind = 3)", "STORED AS CSV LOCATION '/tmp/x'", "STORED AS PARQUET", "LOCATION '/tmp/x' WITH (storage_kind = 'system_memory')", "NONSENSE"],
)
def test_wrong_options_raise(engine, tail):
    with pytest.raises(ValueError):
        engine.sql(f"CREATE TABLE t_wrong (x BIGINT) {tail}")
    assert "t_wrong" not in engine.catalog
    with pytest.raises(ValueError):
        engine.sql("CREATE TABLE t_wrong (x TIMESTAMP)")


def test_external_tables_are_cast_and_written(engine, tmp_path):
    path = str(tmp_path / "t")
    engine.run_script(f"CREATE EXTERNAL TABLE t_ext (r_regionkey BIGINT, r_name VARCHAR) STORED AS PARQUET LOCATION '{path}'; COPY t_ext FROM '{REGION}'; COPY t_ext FROM '{REGION}'")
    assert engine.sql("SELECT * FROM t_ext").dtypes == [("r_regionkey", "bigint"), ("r_name", "string")]
    assert values(engine.sql("SELECT count(*), sum(r_regionkey) FROM t_ext")) == [(10, 20)]


def test_set_and_show(engine):
    assert len(values(engine.sql("SHOW ALL"))) == len(DEFAULTS)
    before = engine.spark.conf.get("spark.sql.shuffle.partitions")
    engine.sql("SET num_shuffle_partitions TO 4")
    assert values(engine.sql("SHOW num_shuffle_partitions")) == [("num_shuffle_partitions", "4")]
    assert engine.spark.conf.get("spark.sql.shuffle.partitions") == "4"
    engine.spark.conf.set("spark.sql.shuffle.partitions", before)
    engine.sql("SET use_partition_pruning = true")
    assert values(engine.sql("SHOW use_partition_pruning")) == [("use_partition_pruning", "true")]
    assert values(engine.sql("SHOW unknown_name")) == []
    for bad in ("SET unknown_name TO 1", "SET max_num_workers TO many", "SET io_engine TO steam", "SET join_use_unique_keys TO maybe"):
        with pytest.raises((KeyError, ValueError)):
            engine.sql(bad)


def test_scripts(engine):
    assert split_script("a; -- b;\nc ';' \"d;\" /* e; */;;") == ["a", "-- b;\nc ';' \"d;\" /* e; */"]
    out = engine.run_script("CREATE VIEW v_s (x) AS SELECT 1 AS y; SELECT x + 1 AS z FROM v_s")
    assert values(out) == [(2,)]
    engine.sql("DROP VIEW v_s")
    with pytest.raises(KeyError):
        engine.sql("DROP VIEW v_s")


def test_snapshots_and_results(engine, tmp_path):
    engine.sql("CREATE TABLE t_snap (r_regionkey INTEGER, r_name VARCHAR)")
    engine.sql(f"COPY t_snap FROM '{REGION}'")
    engine.catalog.save("t_snap", str(tmp_path / "s"))
    engine.catalog.load("t_back", str(tmp_path / "s"), unique_keys=[("r_regionkey",)])
    assert values(engine.sql("SELECT count(*) FROM t_back EXCEPT SELECT count(*) FROM t_snap")) == []
    assert engine.catalog.table("t_back").rows == 5
    engine.write_result(engine.sql("SELECT 1 AS x"), str(tmp_path / "r"))
    assert values(engine.spark.read.parquet(str(tmp_path / "r"))) == [(1,)]


def test_plans_and_plan_files(engine, tmp_path):
    engine.sql("CREATE TABLE t_plan (r_regionkey INTEGER PRIMARY KEY, r_name VARCHAR)")
    engine.sql(f"COPY t_plan FROM '{REGION}'")
    plan = R.Filter(R.Read("t_plan", ("r_name", "r_regionkey")), Ref(1) > 2, (0,))
    assert sorted(values(engine.run_plan(plan))) == sorted(values(engine.run_plan(plan, optimize=False))) == [("EUROPE",), ("MIDDLE EAST",)]
    assert values(engine.run_plan(R.Write(R.Read("t_plan", ("r_regionkey", "r_name")), "t_plan"))) == [(5,)]
    for p, fails in ((plan, False), (R.Write(plan, "t_plan"), True)):
        (tmp_path / "p.json").write_text(json.dumps(R.to_dict(p)))
        if fails:
            with pytest.raises(ValueError):
                engine.run_plan_file(str(tmp_path / "p.json"))
        else:
            assert len(values(engine.run_plan_file(str(tmp_path / "p.json")))) == 4
    with pytest.raises(KeyError):
        engine.run_plan(R.Read("t_none", ("x",)))
    with pytest.raises(KeyError):
        engine.run_plan(R.Read("t_plan", ("x",)), optimize=False)


def test_partition_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    data = [(1, 6, "apple"), (1, 5, "orange"), (3, 4, "duck"), (4, 3, "big"), (5, 2, "random"), (6, 1, "c++")]
    df = spark.createDataFrame(data, "col_0 bigint, col_1 int, col_2 string")
    df.write.partitionBy("col_0").parquet(path)
    some = spark.createDataFrame([(1,), (3,), (5,), (None,)], "v int")
    got = P.read_partitions(spark, path, df.schema, "col_0", some)
    assert sorted(r.col_2 for r in got.collect()) == ["apple", "duck", "orange", "random"]
    with pytest.raises(TypeError):
        P.read_partitions(spark, path, df.schema, "col_0", spark.createDataFrame([("1",)], "v string"))
    plan = spark.read.parquet(path).where("col_0 = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(col_0" in plan
    P.write_files(df, str(tmp_path / "f"), files=2)
    assert len(list((tmp_path / "f").glob("part-*"))) == 2


def test_zone_conditions():
    a, v = Ref(3), Lit(7)
    low, high = Ref(6), Ref(7)
    assert P.zone_condition(a < v) == (low < v) and P.zone_condition(a > v) == (high > v)
    assert P.zone_condition(a.eq(v)) == ((low <= v) & (high >= v))
    assert P.zone_condition(E.Binary("<", v, a)) == (high > v)
    assert P.zone_condition(~(a < v)) == (high >= v)
    assert P.zone_condition((a < v) & E.IsNull(a)) == (low < v) and P.zone_condition((a < v) | E.IsNull(a)) is None
    assert P.zone_condition(~((a < v) | E.IsNull(a))) == (high >= v)
    assert P.zone_condition(E.Cast(a, "i64") < v) is None


def test_filters_reach_the_scan(spark):
    from lodeframe.queries import QUERIES

    plan = QUERIES["filter_between"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
