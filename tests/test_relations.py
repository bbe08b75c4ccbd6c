"""Relations over small hand-made tables: joins, aggregates, windows, sorts, limits, sets and plans."""

import pytest

from lodeframe.functions import expressions as E
from lodeframe.functions.expressions import Lit, Ref
from lodeframe.operators import udr
from lodeframe.plans import relations as R
from lodeframe.plans.compile import compile_plan


def table(spark, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return R.UserDefined((), lambda: df, tuple(df.columns))


def rows(plan):
    return [tuple(r) for r in compile_plan(plan, None).collect()]


def sort(found):
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])


SETS = {
    "basic": ([2, 1, 1, 3, 4, 1], range(6), [3, 1, 5, 1, 2], range(5)),
    "simple": ([1, 2, 3], [10, 20, 30], [2, 3, 4], [200, 300, 400]),
    "duplicates": ([1, 1, 1, 2, 2], [10, 11, 12, 20, 21], [1, 1, 3], [100, 101, 300]),
    "empty_left": ([], [], [3, 1, 5, 1, 2], range(5)),
    "empty_right": ([2, 1, 1, 3, 4, 1], range(6), [], []),
    "empty": ([], [], [], []),
    "nulls": ([None, 1, 1, 3, 4, 1], range(6), [3, 1, 5, 1, None], range(5)),
}
CONDITIONS = {
    "equal": (Ref(0).eq(Ref(2)), lambda a, b: None not in (a[0], b[0]) and a[0] == b[0]),
    "null_safe": (Ref(0).same(Ref(2)), lambda a, b: a[0] == b[0]),
    "mixed": (Ref(0).eq(Ref(2)) & (Ref(1) > Ref(3)), lambda a, b: None not in (a[0], b[0]) and a[0] == b[0] and a[1] > b[1]),
    "theta": (Ref(1) < Ref(3), lambda a, b: a[1] < b[1]),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("condition", CONDITIONS)
def test_join_matrix(spark, name, condition):
    lk, lp, rk, rp = SETS[name]
    left, right = list(zip(lk, lp, strict=True)), list(zip(rk, rp, strict=True))
    a, b = table(spark, "k bigint, p bigint", left), table(spark, "k bigint, p bigint", right)
    on, meets = CONDITIONS[condition]
    pairs = [(x, y) for x in left for y in right if meets(x, y)]
    lonely = [x for x in left if all(x is not u for u, _ in pairs) and not any(meets(x, y) for y in right)]
    want = {
        "inner": [x + y for x, y in pairs],
        "left": [x + y for x, y in pairs] + [(*x, None, None) for x in lonely],
        "left_semi": [x for x in left if x not in lonely],
        "left_anti": lonely,
        "full": [x + y for x, y in pairs] + [(*x, None, None) for x in lonely] + [(None, None, *y) for y in right if not any(meets(x, y) for x in left)],
    }
    for how, expected in want.items():
        assert sort(rows(R.Join(a, b, on, how))) == sort(expected), how


def test_single_join_and_projection(spark):
    a, b = table(spark, "k bigint", [(1,), (2,), (None,)]), table(spark, "k bigint, v string", [(1, "x"), (3, "y")])
    assert sort(rows(R.Join(a, b, Ref(0).eq(Ref(1)), "single"))) == sort([(1, 1, "x"), (2, None, None), (None, None, None)])
    assert sort(rows(R.Join(a, b, Ref(0).eq(Ref(1)), "inner", (2, 0, 2)))) == [("x", 1, "x")]
    twice = table(spark, "k bigint, v string", [(1, "x"), (1, "y")])
    with pytest.raises(Exception, match="more than one match"):
        rows(R.Join(a, twice, Ref(0).eq(Ref(1)), "single"))
    other = table(spark, "k bigint, v string", [(1, "x"), (9, "y"), (9, "z"), (None, "n"), (None, "m")])
    assert sort(rows(R.Join(a, other, Ref(0).eq(Ref(1)), "single"))) == sort([(1, 1, "x"), (2, None, None), (None, None, None)])
    with pytest.raises(Exception, match="more than one match"):
        rows(R.Join(a, other, Ref(0).same(Ref(1)), "single"))
    with pytest.raises(Exception, match="more than one match"):
        rows(R.Join(a, other, Ref(0) < Ref(1), "single"))


AGG = [("apple", 0, 0, True), (None, 1, 1, False), ("apple", 0, None, True), ("apple", 1, 4, True), (None, 1, 8, True), ("orange", 0, 16, True), ("orange", 1, 32, True), ("apple", 1, 64, False)]


def test_aggregates(spark):
    t = table(spark, "a string, b int, c bigint, m boolean", AGG)
    assert rows(R.Aggregate(t, (), (("sum", Ref(1)), ("sum", Ref(2)), ("max", Ref(2))))) == [(5, 125, 64)]
    got = rows(R.Aggregate(t, (Ref(0), Ref(1)), (("sum", Ref(2)),), Ref(3)))
    assert sort(got) == sort([(None, 1, 8), ("apple", 0, 0), ("apple", 1, 4), ("orange", 0, 16), ("orange", 1, 32)])
    assert rows(R.Aggregate(t, (), (("count_all", None), ("count_valid", Ref(2)), ("product", Ref(1) + 1), ("any", Ref(3)), ("all", Ref(3))))) == [(8, 7, 32, True, False)]
    assert rows(R.Aggregate(R.Filter(t, Lit(False)), (), (("sum", Ref(1)), ("count_all", None)))) == [(None, 0)]
    assert rows(R.Aggregate(R.Filter(t, Lit(False)), (Ref(0),), (("sum", Ref(1)),))) == []


def test_mean_over_two_files(spark, tmp_path):
    for i, values in enumerate(([1.0, 2.0, 3.0], [4.0, 5.0])):
        spark.createDataFrame([(v,) for v in values], "values double").coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    df = spark.read.parquet(str(tmp_path)).select("values")
    t = R.UserDefined((), lambda: df)
    assert rows(R.Aggregate(t, (), tuple((k, Ref(0)) for k in ("avg", "sum", "min", "max")))) == [(3.0, 15.0, 1.0, 5.0)]


def test_windows(spark):
    def run(schema, data, **w):
        found = rows(R.Window(table(spark, schema, data), **w))
        return sorted((r[-2], r[-1]) for r in found)

    part, arg, order = (1, 1, 2, 1, 2, 2, 1), (1, 2, 4, 3, 5, 6, 2), (6, 5, 4, 3, 2, 1, 7)
    data = list(zip(part, arg, order, range(7), strict=True))
    by = ((Ref(2), True, True),)
    schema = "p int, a int, o int, i int"
    assert run(schema, data, function="sum", arguments=(Ref(1),), order_by=by, partition_by=(Ref(0),)) == [(0, 6), (1, 5), (2, 15), (3, 3), (4, 11), (5, 6), (6, 8)]
    whole = list(zip(part, (1, 2, 3, 4, 5, 6, 2), order, range(7), strict=True))
    assert run(schema, whole, function="sum", arguments=(Ref(1),), order_by=by) == [(0, 21), (1, 20), (2, 18), (3, 15), (4, 11), (5, 6), (6, 23)]
    ranks = list(zip((1, 1, 2, 3, 2, 2, 1, 1), (5, 5, 4, 3, 2, 1, 0, 6), range(8), strict=True))
    by = ((Ref(1), True, True),)
    assert run("p int, o int, i int", ranks, function="rank", order_by=by, partition_by=(Ref(0),)) == [(0, 2), (1, 2), (2, 3), (3, 1), (4, 2), (5, 1), (6, 1), (7, 4)]
    assert run("p int, o int, i int", ranks, function="rank", order_by=by) == [(0, 6), (1, 6), (2, 5), (3, 4), (4, 3), (5, 2), (6, 1), (7, 8)]
    with pytest.raises(ValueError):
        run("p int, o int, i int", ranks, function="rank", partition_by=(Ref(0),))
    with pytest.raises(ValueError):
        run("p int, o string, i int", [(1, "x", 0)], function="sum", arguments=(Ref(0),), order_by=((Ref(1), True, True),), lower=-1)


def test_partition_windows_keep_null_partitions(spark):
    t = table(spark, "k int, v int", [(1, 1), (2, 2), (1, 3), (None, 4), (None, 5)])
    assert sort(rows(R.Window(t, "sum", (Ref(1),), (), (Ref(0),)))) == sort([(1, 1, 4), (2, 2, 2), (1, 3, 4), (None, 4, 9), (None, 5, 9)])


def test_sorts_put_nulls_where_told(spark):
    t = table(spark, "a bigint, b bigint", list(zip(range(10), (5, 3, 4, 8, 1, 9, 6, None, 2, 0), strict=True)))
    run = lambda up, first: [r[0] for r in rows(R.Sort(t, ((Ref(1), up, first),)))]
    assert run(True, False) == [9, 4, 8, 1, 2, 0, 6, 3, 5, 7]
    assert run(False, True) == [7, 5, 3, 6, 0, 2, 1, 8, 4, 9]
    assert run(False, False) == [5, 3, 6, 0, 2, 1, 8, 4, 9, 7]


def test_fetch(spark):
    t = R.Sort(table(spark, "a bigint", [(i,) for i in range(10)]), ((Ref(0), True, True),))
    run = lambda *a: [r[0] for r in rows(R.Fetch(t, *a))]
    assert run(1, 4) == [1, 2, 3, 4] and run(1) == list(range(1, 10)) and run(20, 4) == [] and run(0, 0) == []
    with pytest.raises(ValueError):
        run(0, 1 << 31)


def test_filters_and_empty_projections(spark):
    t = table(spark, "a int, b int, c boolean", [(i, i + 10, i % 2 == 1) for i in range(1, 11)])
    assert [r[0] for r in sort(rows(R.Filter(t, Ref(2))))] == [1, 3, 5, 7, 9]
    assert sort(rows(R.Filter(t, Ref(2), (1,)))) == [(11,), (13,), (15,), (17,), (19,)]
    assert compile_plan(R.Filter(t, Ref(2), ()), None).count() == 5
    unknown = table(spark, "c boolean", [(None,), (True,), (False,)])
    assert rows(R.Filter(unknown, Ref(0))) == [(True,)]


def test_sets_need_equal_types(spark):
    a, b = table(spark, "x int", [(1,), (1,), (2,), (None,)]), table(spark, "x int", [(1,), (3,), (None,)])
    want = {"union_all": [1, 1, 2, None, 1, 3, None], "union": [1, 2, 3, None], "intersect": [1, None], "minus": [2], "intersect_all": [1, None], "minus_all": [1, 2]}
    for kind, values in want.items():
        assert sort(rows(R.SetOp(kind, a, b))) == sort([(v,) for v in values]), kind
    with pytest.raises(TypeError):
        rows(R.SetOp("union_all", a, table(spark, "x string", [("a",)])))


def test_plans_compare_print_and_serialise():
    import json

    plan = R.Sort(R.Aggregate(R.Filter(R.Read("t", ("a", "b")), E.Like(Ref(1), "x%"), (0,)), (Ref(0),), (("sum", Ref(0)), ("count_all", None))), ((Ref(1), False, True),))
    again = R.from_dict(json.loads(json.dumps(R.to_dict(plan))))
    assert again == plan and R.to_string(plan).count("\n") == 3
    assert plan != R.Sort(plan.input, ((Ref(1), True, True),))
    with pytest.raises(ValueError):
        R.to_dict(udr.relation(lambda: None))
    with pytest.raises(ValueError):
        R.from_dict({"kind": "Mystery"})
