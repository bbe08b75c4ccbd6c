"""Joins of equalities and one comparison, on few and hot keys, against the plain join."""

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.expressions import Ref
from lodeframe.operators import joins
from lodeframe.operators.joins import join_frames

NAN = float("nan")
LEFT = [(k, v, i) for i, (k, v) in enumerate([(k, float(v)) for k in (1, 2, 3, None) for v in range(7)] + [(1, None), (1, NAN), (2, -0.0), (None, None), (5, 1.0)])] + [(1, 3.0, 99)] * 9
RIGHT = [(k, v, i) for i, (k, v) in enumerate([(k, float(v)) for k in (1, 2, 4, None) for v in range(-2, 9, 2)] + [(1, None), (1, NAN), (2, 0.0), (None, NAN), (6, 1.0)])] + [(2, 4.0, 98)] * 8
K, SAME, V, W = Ref(0).eq(Ref(3)), Ref(3).same(Ref(0)), Ref(1), Ref(4)
CONDITIONS = {
    "more": K & (V > W),
    "less_and_own": K & (V < W) & (W > 3.0),
    "own_left": K & (V <= W) & (V > 2.0) & (Ref(5) < 20),
    "flipped": SAME & (W + 1.0 <= V),
    "null_safe": SAME & (V < W),
}


def plain_and_mixed(spark, monkeypatch, name, how):
    a, b = spark.createDataFrame(LEFT, "k int, v double, i int"), spark.createDataFrame(RIGHT, "k int, w double, j int")
    with monkeypatch.context() as m:
        m.setattr(joins, "_mixed", lambda *_: None, raising=False)
        plain = join_frames(a, b, CONDITIONS[name], how).collect()
    monkeypatch.setattr(joins, "CELL", 3, raising=False)
    taken = []
    inner = joins._mixed_join
    monkeypatch.setattr(joins, "_mixed_join", lambda *x: taken.append(1) or inner(*x))
    got = join_frames(a, b, CONDITIONS[name], how).collect()
    assert taken and plain
    assert sorted(map(str, got)) == sorted(map(str, plain))


@pytest.mark.parametrize("name", CONDITIONS)
def test_inner(spark, monkeypatch, name):
    plain_and_mixed(spark, monkeypatch, name, "inner")


def test_a_hot_key_is_dealt_to_many_partitions(spark):
    a, b = (spark.range(6000).selectExpr("int(id < 0) AS k", "id AS v").coalesce(1) for _ in range(2))
    df = join_frames(a, b, Ref(0).eq(Ref(2)) & (Ref(1) > Ref(3)))
    got = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(got) == 6000 * 5999 // 2 and max(got) < sum(got) / 2


def test_a_side_that_may_change_is_read_once(spark):
    a, b = spark.range(100).selectExpr("1 AS k", "id AS v"), spark.range(100).selectExpr("1 AS k", "id AS v")
    for changing in (a.withColumn("v", F.rand()), a.limit(50)):
        assert not joins._rereadable(changing)
        df = join_frames(changing, b, Ref(0).eq(Ref(2)) & (Ref(1) >= Ref(3)), "left")
        assert "xxhash64" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", CONDITIONS)
@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_semi_and_anti(spark, monkeypatch, name, how):
    plain_and_mixed(spark, monkeypatch, name, how)


@pytest.mark.parametrize("name", CONDITIONS)
@pytest.mark.parametrize("how", ["left", "full"])
def test_rows_without_a_match_stay_once(spark, monkeypatch, name, how):
    plain_and_mixed(spark, monkeypatch, name, how)
