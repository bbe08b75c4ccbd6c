"""Rewrite rules: plan in, plan out."""

import pytest

from lodeframe.functions.expressions import Cast, Lit, Not, Ref
from lodeframe.plans import relations as R
from lodeframe.plans.rules import RULES, Keys, Optimizer, Rule, estimate, unique_keys


class Info:
    def __init__(self, columns, keys=(), rows=100):
        self.columns, self.unique_keys, self.rows = columns, keys, rows


class Catalog:
    def __init__(self, **tables):
        self.tables = tables

    def table(self, name):
        return self.tables[name]


CAT = Catalog(t=Info(["a", "b", "c"], [("a",)], 100), u=Info(["x", "y"], [("x", "y"), ("x",)], 10), w=Info(["k", "v"], [], 1000))
T, U, W = R.Read("t", ("a", "b", "c")), R.Read("u", ("x", "y")), R.Read("w", ("k", "v"))


def apply(name, plan):
    rule = Rule(name, RULES[name])
    out = rule(plan, CAT)
    assert rule(out, CAT) == out  # once is enough
    return out


def test_constant_folding():
    assert apply("constant_folding", R.Filter(T, Lit(True))) == T
    assert apply("constant_folding", R.Filter(T, Lit(True), (2, 0))) == R.Project(T, (Ref(2), Ref(0)))
    for kept in (R.Filter(T, Lit(False)), R.Filter(T, Lit(True) & (Ref(0) > 1))):
        assert apply("constant_folding", kept) == kept
    assert apply("constant_folding", R.Read("t", ("a",), Lit(True))) == R.Read("t", ("a",))


def test_projection_pushdown():
    f = R.Filter(T, Ref(0) > 1, (2, 1))
    assert apply("projection_pushdown", R.Project(f, (Ref(1), Ref(0), Ref(1)))) == R.Filter(T, Ref(0) > 1, (1, 2, 1))
    j = R.Join(T, U, Ref(0).eq(Ref(3)))
    assert apply("projection_pushdown", R.Project(j, (Ref(4), Ref(0)))) == R.Join(T, U, Ref(0).eq(Ref(3)), "inner", (4, 0))
    assert apply("projection_pushdown", R.Project(T, (Ref(2) + 1,))) == R.Project(R.Read("t", ("c",)), (Ref(0) + 1,))
    assert apply("projection_pushdown", R.Project(R.Filter(T, Ref(0) > 1), (Ref(2) + 1,))) == R.Project(R.Filter(T, Ref(0) > 1, (2,)), (Ref(0) + 1,))


def test_expression_extraction():
    plan = R.Aggregate(T, (Ref(0) + 1, Ref(1)), (("sum", Ref(2) * 2), ("count_all", None), ("max", Ref(0) + 1)))
    want = R.Aggregate(R.Project(T, (Ref(0), Ref(1), Ref(2), Ref(0) + 1, Ref(2) * 2)), (Ref(3), Ref(1)), (("sum", Ref(4)), ("count_all", None), ("max", Ref(3))))
    assert apply("expression_extraction", plan) == want


def test_mean_decomposition():
    plan = R.Aggregate(T, (Ref(0),), (("avg", Ref(1)), ("sum", Ref(1)), ("avg", Ref(2))))
    inner = R.Aggregate(T, (Ref(0),), (("sum", Ref(1)), ("count_valid", Ref(1)), ("sum", Ref(2)), ("count_valid", Ref(2))))
    assert apply("mean_decomposition", plan) == R.Project(inner, (Ref(0), Ref(1) / Ref(2), Ref(1), Ref(3) / Ref(4)))
    assert apply("mean_decomposition", inner) == inner


def test_not_not():
    assert apply("not_not", R.Filter(T, Not(Not(Not(Ref(0) > 1))))) == R.Filter(T, Not(Ref(0) > 1))


@pytest.mark.parametrize("left,right,on,mark", [(T, U, Ref(0).eq(Ref(3)), "either"), (T, W, Ref(0).eq(Ref(3)), "left"), (W, T, Ref(0).eq(Ref(2)), "right"), (W, W, Ref(0).eq(Ref(2)), "none"), (T, W, Ref(0) > Ref(3), "none")])
def test_join_unique_keys(left, right, on, mark):
    assert apply("join_unique_keys", R.Join(left, right, on)).unique == mark
    assert apply("join_unique_keys", R.Join(left, right, on, "left")).unique == "none"


def test_partial_filters_count_table_columns():
    plan = R.Filter(R.Read("t", ("c", "a")), Ref(1) > 1)
    assert apply("partial_filters", plan) == R.Filter(R.Read("t", ("c", "a"), Ref(0) > 1), Ref(1) > 1)


def test_children_swap_and_broadcast_side():
    plan = R.Join(U, W, Ref(0).eq(Ref(2)))
    assert apply("join_children_swap", plan) == R.Join(W, U, Ref(2).eq(Ref(0)), "inner", (2, 3, 0, 1))
    assert apply("broadcast_side", plan).hint == "broadcast_left"
    assert apply("broadcast_side", R.Join(W, U, Ref(0).eq(Ref(2)))).hint == "broadcast_right"


def test_distinct_over_a_key_needs_no_group_by():
    assert apply("unique_group_by", R.Aggregate(T, (Ref(0), Ref(1)), ())) == R.Project(T, (Ref(0), Ref(1)))
    kept = R.Aggregate(T, (Ref(1),), ())
    assert apply("unique_group_by", kept) == kept


KEYS = [
    (T, {(0,)}),
    (U, {(0,), (0, 1)}),
    (R.Read("u", ("y", "x")), {(1,), (0, 1)}),
    (R.Read("t", ("b",)), set()),
    (R.Aggregate(W, (), (("sum", Ref(0)), ("max", Ref(1)))), {(0,), (1,)}),
    (R.Aggregate(W, (Ref(0),), (("sum", Ref(1)),)), {(0,)}),
    (R.Aggregate(T, (Ref(0), Ref(1)), ()), {(0, 1), (0,)}),
    (R.SetOp("union", W, W), {(0, 1)}),
    (R.SetOp("union_all", T, T), set()),
    (R.SetOp("intersect", T, T), {(0,)}),
    (R.SetOp("minus", T, W), {(0,)}),
    (R.Project(T, (Ref(1), Ref(0), Ref(0) + 1)), {(1,), (2,)}),
    (R.Project(T, (Cast(Ref(0), "i64"),)), set()),
    (R.Project(U, (Ref(0), Ref(1), Ref(0))), {(0,), (2,), (0, 1), (1, 2)}),
    (R.Filter(T, Ref(1) > 1, (1, 0)), {(1,)}),
    (R.Sort(R.Fetch(T, 1), ((Ref(0), True, True),)), {(0,)}),
    (R.Window(T, "rank", (), ((Ref(0), True, True),)), {(0,)}),
    (R.Join(W, T, Ref(0).eq(Ref(2))), set()),
    (R.Join(T, W, Ref(0).eq(Ref(3))), set()),
    (R.Join(T, U, Ref(0).eq(Ref(3))), {(0,), (3,), (3, 4)}),
    (R.Join(T, U, Ref(1).eq(Ref(3))), {(0,)}),
    (R.Join(T, U, Ref(1).eq(Ref(3)), "inner", (4, 0)), {(1,)}),
    (R.Join(T, U, Ref(0).eq(Ref(3)), "left"), set()),
    (R.Join(T, W, Ref(0).eq(Ref(3)), "left_semi"), {(0,)}),
    (R.Join(T, W, Ref(0).eq(Ref(3)), "single"), {(0,)}),
    (R.RowId(W), {(2,)}),
]


@pytest.mark.parametrize("plan,keys", KEYS)
def test_uniqueness(plan, keys):
    assert unique_keys(plan, CAT).keys == keys


def test_keys_are_normal_and_cover():
    k = Keys([(2, 1, 1)])
    assert k.keys == {(1, 2)} and k.covered_by([0, 1, 2]) and not k.covered_by([1])
    with pytest.raises(ValueError):
        k.add(())


def test_estimates():
    f = R.Filter(T, Ref(0) > 1)
    for plan, n in ((T, 100), (f, 100), (R.Join(T, W, Lit(True)), 1000), (R.Fetch(T, 0, 7), 7), (R.SetOp("union_all", T, U), 110), (R.SetOp("intersect", T, U), 10), (R.SetOp("minus", T, U), 100), (R.Write(T, "t"), 0), (R.UserDefined((T, W), len), 1000)):
        assert estimate(plan, CAT) == n


def test_off_wins_over_on():
    o = Optimizer(("constant_folding", "not_not"), off=("constant_folding",))
    assert [r.name for r in o.rules] == ["not_not"]
    o(R.Filter(T, Not(Not(Ref(0) > 1))), CAT)
    assert o.counts == {"not_not": 1}
    with pytest.raises(ValueError):
        Optimizer(("mystery",))
