"""Literal cases of expressions: inputs and results as given by hand."""

import datetime
import math

import pytest

from lodeframe.functions import expressions as E
from lodeframe.functions.expressions import Case, Cast, DatePart, IsNull, Like, Lit, Not, Ref, Round, Substring
from lodeframe.functions.types import spark_type
from lodeframe.plans.compile import columns_of, types_of


def run(spark, schema, rows, expr):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", _i int")
    c, t = E.compile(expr, columns_of(df), types_of(df))
    out = df.select("_i", c.alias("v"))
    assert out.schema["v"].dataType == t
    return [r.v for r in sorted(out.collect(), key=lambda r: r._i)], t.simpleString()


A, B = (2, 5, 3, 6), (5, 4, 3, 3)


@pytest.mark.parametrize(
    "types,expr,want,kind",
    [
        ("a int, b bigint", Ref(0) + Ref(1), [7, 9, 6, 9], "bigint"),
        ("a bigint, b float", Ref(0) + Ref(1), [7, 9, 6, 9], "double"),
        ("a int, b int", Ref(0) - Ref(1), [-3, 1, 0, 3], "bigint"),
        ("a int, b int", Ref(0) * Ref(1), [10, 20, 9, 18], "bigint"),
        ("a int, b bigint", Ref(0) / Ref(1), [0.4, 1.25, 1.0, 2.0], "double"),
        ("a int, b int", Ref(0) > Ref(1), [False, True, False, True], "boolean"),
        ("a int, b int", Ref(0).eq(Ref(1)), [False, False, True, False], "boolean"),
        ("a int, b int", (Ref(0) > 2) & (Ref(1) > 3), [False, True, False, False], "boolean"),
        ("a int, b int", E.in_list(Ref(0), (3, 6)), [False, False, True, True], "boolean"),
        ("a int, b int", E.between(Ref(0), 3, 5), [False, True, True, False], "boolean"),
    ],
)
def test_arithmetic_and_comparison(spark, types, expr, want, kind):
    rows = [(a, float(b)) if "float" in types else (a, b) for a, b in zip(A, B, strict=True)]
    assert run(spark, types, rows, expr) == (want, kind)


def test_logic_is_three_valued(spark):
    rows = [(x, y) for x in (True, False, None) for y in (True, False, None)]
    both, _ = run(spark, "a boolean, b boolean", rows, Ref(0) & Ref(1))
    either, _ = run(spark, "a boolean, b boolean", rows, Ref(0) | Ref(1))
    assert both == [True, False, None, False, False, False, None, False, None]
    assert either == [True, True, True, True, False, None, True, None, None]


def test_case_takes_the_first_true_branch(spark):
    rows = [(True, 42, 52), (False, 43, 53), (False, 44, 54), (True, 45, 55), (None, 1, 2)]
    assert run(spark, "c boolean, a int, b int", rows, Case(((Ref(0), Ref(1)),), Ref(2)))[0] == [42, 53, 54, 45, 2]
    with pytest.raises(TypeError):
        run(spark, "c boolean, a int, b string", [(True, 1, "x")], Case(((Ref(0), Ref(1)),), Ref(2)))


@pytest.mark.parametrize(
    "pattern,escape,inputs,want",
    [
        ("%a_aa%", "\\", ["azaa", "ababaabba", "aaxa"], [True, True, False]),
        ("ab%a_aa%b", "\\", [None, "ababaabba", None, "ababaaxxxxxxxxbb", "ababaabx"], [None, False, None, True, False]),
        ("MEDIUM POLISHED%", "\\", ["MEDIUM PLATED NICKEL", "MEDIUM POLISHED COPPER", "MEDIUM BRUSHED BRASS"], [False, True, False]),
        ("a\\", "\\", ["a", "a\\", None], [False, False, None]),
        ("100!%", "!", ["100%", "1000"], [True, False]),
        ("a!!b", "!", ["a!b", "a!!b"], [True, False]),
        ("\\%x", "!", ["\\%x", "\\abcx", "abcx"], [True, True, False]),
        ("_é_", "\\", ["aéb", "éé", "日é本"], [True, False, True]),
    ],
)
def test_like(spark, pattern, escape, inputs, want):
    assert run(spark, "s string", [(x,) for x in inputs], Like(Ref(0), pattern, escape))[0] == want


def test_ilike_substring_round_null(spark):
    assert run(spark, "s string", [("Azaa",), ("b",)], Like(Ref(0), "a%", ignore_case=True))[0] == [True, False]
    assert run(spark, "s string", [("azaa",), ("ababaabba",), ("aaxa",)], Substring(Ref(0), 2, 2))[0] == ["za", "ba", "ax"]
    with pytest.raises(ValueError):
        run(spark, "s string", [("a",)], Substring(Ref(0), 0, 2))
    assert run(spark, "x double", [(2.5,), (-2.5,)], Round(Ref(0)))[0] == [3.0, -3.0]
    assert run(spark, "x int", [(None,), (2,)], IsNull(Ref(0)))[0] == [True, False]
    assert run(spark, "x int", [(None,), (2,)], Not(IsNull(Ref(0))))[0] == [False, True]
    assert run(spark, "x int", [(None,), (2,)], Ref(0).same(Lit(None, "i32")))[0] == [True, False]
    with pytest.raises(TypeError):
        run(spark, "x int", [(1,)], Ref(0).eq(Lit(None)))


def test_date_parts(spark):
    rows = [(datetime.date(1970, 1, 1),), (datetime.date(2023, 1, 1),)]
    assert run(spark, "d date", rows, DatePart("year", Ref(0))) == ([1970, 2023], "smallint")
    assert run(spark, "d date", rows, DatePart("weekday", Ref(0)))[0] == [4, 7]
    at = [(datetime.datetime(2024, 2, 3, 4, 5, 6, 789000),)]
    assert [run(spark, "t timestamp_ntz", at, DatePart(p, Ref(0)))[0][0] for p in ("month", "day", "hour", "minute", "second", "millisecond", "nanosecond")] == [2, 3, 4, 5, 6, 789, 0]
    with pytest.raises(ValueError):
        run(spark, "d date", rows, DatePart("century", Ref(0)))


def test_division_by_zero_is_ieee(spark):
    got, _ = run(spark, "a double, b double", [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (None, 0.0), (1.0, None)], Ref(0) / Ref(1))
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [-math.inf, None, None]


def test_types():
    assert spark_type("DECIMAL(15, 2)").simpleString() == "double"
    assert spark_type("decimal(15,2)", exact_decimals=True).simpleString() == "decimal(15,2)"
    assert spark_type("VARCHAR(25)").simpleString() == "string" and spark_type("double precision").simpleString() == "double"
    for bad in ("timestamp", "interval", "array<int>", "blob"):
        with pytest.raises(ValueError):
            spark_type(bad)


def test_wrong_types_raise(spark):
    for e in (Ref(0) + Ref(1), Ref(0) / Ref(1), Ref(0) < Ref(1)):
        with pytest.raises(TypeError):
            run(spark, "a int, s string", [(1, "x")], e)
    assert run(spark, "a int, s string", [(1, "2")], Cast(Ref(1), "i64") + Ref(0))[0] == [3]


def test_expressions_compare_and_print():
    e = (Ref(0, "a") + 1).eq(Ref(1)) & ~IsNull(Ref(2))
    assert e == (Ref(0) + 1).eq(Ref(1)) & ~IsNull(Ref(2)) and hash(e) and e != (Ref(0) + 2).eq(Ref(1))
    assert E.refs(e) == {0, 1, 2} and E.refs(E.remap(e, {0: 5, 1: 6, 2: 7})) == {5, 6, 7}
    assert str(e) == "(((a + 1) = $1) and NOT ($2 IS NULL))"
