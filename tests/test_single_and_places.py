"""Single joins under any projection, argmin and argmax, side filters, and joins on unique keys."""

import pytest
from pyspark.errors import SparkRuntimeException

from lodeframe.functions import expressions as E
from lodeframe.functions.expressions import Ref
from lodeframe.plans import relations as R
from lodeframe.plans.compile import compile_plan
from lodeframe.plans.rules import Optimizer
from lodeframe.queries import QUERIES
from lodeframe.session import Engine


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.catalog.register_frame("one", spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, x string"))
    e.catalog.register_frame("two", spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 30), (9, 40)], "k int, y int"))
    e.catalog.register_frame("keyed", spark.createDataFrame([(1, 10), (2, 20), (9, 40)], "k int, y int"), unique_keys=[("k",)])
    e.catalog.register_frame("vals", spark.createDataFrame([("a", 3, 7), ("a", 1, 6), ("a", 1, 5), ("a", None, 4), ("b", None, 3), ("c", 9, 2)], "g string, v int, id int").coalesce(1))
    return e


ONE, TWO, KEYED = R.Read("one", ("k", "x")), R.Read("two", ("k", "y")), R.Read("keyed", ("k", "y"))
ON = Ref(0).eq(Ref(2))


@pytest.mark.parametrize("projection", [None, (0,), (1,), (3,), (1, 3), (2, 3)])
@pytest.mark.parametrize("condition", [ON, ON & (Ref(3) > 0)])
def test_a_second_match_raises_under_any_projection(engine, projection, condition):
    df = engine.run_plan(R.Join(ONE, TWO, condition, "single", projection))
    with pytest.raises(SparkRuntimeException, match="more than one match"):
        df.collect()
    with pytest.raises(SparkRuntimeException, match="more than one match"):
        df.count()


@pytest.mark.parametrize("condition", [ON, ON & (Ref(3) > 0)])
def test_one_match_or_none(engine, condition):
    got = engine.run_plan(R.Join(ONE, KEYED, condition, "single", (1, 3))).collect()
    assert sorted(map(tuple, got)) == [("a", 10), ("b", 20), ("c", None), ("d", None)]


def test_a_repeated_key_without_a_left_row_is_fine(engine):
    few = R.Filter(ONE, Ref(0).eq(1))
    assert [tuple(r) for r in engine.run_plan(R.Join(few, TWO, ON, "single", (1, 3))).collect()] == [("a", 10)]


@pytest.mark.parametrize("kind,want", [("argmin", {"a": 5, "b": None, "c": 2}), ("argmax", {"a": 7, "b": None, "c": 2})])
def test_places_are_row_ids(engine, kind, want):
    """Of equal values the smallest row id; all null gives null. The id finds its row again."""
    rows = R.RowId(R.Read("vals", ("g", "v", "id")))
    agg = R.Aggregate(rows, (Ref(0),), ((kind, Ref(1)),))
    ids = {r[3]: r[2] for r in engine.run_plan(rows).collect()}
    got = {r[0]: r[1] for r in engine.run_plan(agg).collect()}
    if kind == "argmin":
        assert got["a"] == min(i for i, x in ids.items() if x in (5, 6))
        want = want | {"a": ids[got["a"]]}
    assert {g: ids.get(i) for g, i in got.items()} == want
    plain = R.Aggregate(R.Read("vals", ("g", "v", "id")), (Ref(0),), ((kind, Ref(1)), ("count_all", None)), Ref(2) < 7)
    assert {r[0]: r[2] for r in engine.run_plan(plain).collect()} == {"a": 3, "b": 1, "c": 1}


def test_side_filters(engine):
    got = engine.run_plan(R.Join(ONE, TWO, ON, "left", (1, 3), left_filter=Ref(1) > "a", right_filter=Ref(1) < 21)).collect()
    assert sorted(map(tuple, got), key=str) == [("b", 20), ("c", None), ("d", None)]
    back = R.from_dict(R.to_dict(R.Join(ONE, TWO, ON, "left", None, left_filter=Ref(1) > "a")))
    assert back.left_filter == (Ref(1) > "a") and back.right_filter is None
    swapped = Optimizer(("join_children_swap",))(R.Join(R.Fetch(ONE, 0, 1), TWO, ON, left_filter=Ref(1) > "a"), _Rows())
    assert swapped.right_filter == (Ref(1) > "a") and swapped.left_filter is None


class _Rows:
    """A catalog that knows only row counts."""

    def table(self, name):
        return type("Info", (), {"rows": 5, "unique_keys": [], "columns": ["k", "x"]})


def test_a_unique_side_that_gives_no_column_only_filters(engine):
    plan = Optimizer(("join_unique_keys",))(R.Join(ONE, KEYED, ON, "inner", (1,)), engine.catalog)
    assert plan.unique == "right"
    df = engine.run_plan(plan)
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in df.collect()) == ["a", "b"]
    twice = Optimizer(("join_unique_keys",))(R.Join(ONE, TWO, ON, "inner", (1,)), engine.catalog)
    assert sorted(r[0] for r in compile_plan(twice, engine).collect()) == ["a", "b", "b"]


def test_byte_columns_and_one_character(engine, spark):
    engine.catalog.register_frame("bytes", spark.createDataFrame([(65, 1), (66, 2)], "c tinyint, n int"))
    read = R.Read("bytes", ("c", "n"))
    rule = Optimizer(("string_to_int_literal",))
    for left in (Ref(0), E.Cast(Ref(0), "string")):
        plan = rule(R.Filter(read, E.Binary("=", left, E.Lit("A"))), engine.catalog)
        assert plan.condition == E.Binary("=", Ref(0), E.Lit(65, "i8"))
        assert [r.n for r in compile_plan(plan, engine).collect()] == [1]
    for kept in (E.Binary("=", E.Cast(Ref(0), "string"), E.Lit("AB")), E.Binary("=", E.Cast(Ref(1), "string"), E.Lit("1")), E.Binary("<", E.Cast(Ref(0), "string"), E.Lit("A"))):
        assert rule(R.Filter(read, kept), engine.catalog).condition == kept


def test_a_build_side_used_twice_is_built_once(spark):
    df = QUERIES["join_reused_build"](spark, "/root/testdata/sf0.01")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("BroadcastHashJoin") == 2


def test_concatenated_partitions_are_one(spark):
    df = QUERIES["concatenate"](spark, "/root/testdata/sf0.01")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 50
