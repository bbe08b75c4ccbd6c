"""One query for each operator: logical plans where the plan API expresses it, SQL text otherwise."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import expressions as E
from lodeframe.functions.expressions import Cast, DatePart, IsNull, Like, Lit, Ref, Round, Substring, between, in_list
from lodeframe.operators import udr
from lodeframe.plans import relations as R
from lodeframe.queries.registry import Tables, add, plan_query, read, run, sql_query
from lodeframe.session import Engine
from lodeframe.sources import parquet as P
from lodeframe.sources.options import DEFAULTS, option_text
from lodeframe.sources.shared import fresh_path, written

LINE = read("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
PART = read("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
NATION = read("nation", "n_nationkey", "n_name", "n_regionkey")
REGION = read("region", "r_regionkey", "r_name")
CUSTOMER = read("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
SUPPLIER = read("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
ORDERS = read("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
EVENTS = read("events", "event_id", "ts", "user_id", "event_type", "value")


def project(source, *exprs):
    return R.Project(source, tuple(exprs))


# --- scans, projections, filters -----------------------------------------------------------------

plan_query("scan_projection", LINE, ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
plan_query("scan_partial_filter", R.Read("part", ("p_partkey", "p_brand"), Ref(4) > 40), ("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE p_size > 40")
plan_query("filter_and_or_not", R.Filter(PART, ((Ref(4) > 20) & Ref(2).eq("Brand#1")) | ~(Ref(5) < 1500.0), (0, 2)), ("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE (p_size > 20 AND p_brand = 'Brand#1') OR NOT (p_retailprice < 1500.0)")
plan_query("filter_between", R.Filter(PART, between(Ref(4), 10, 20), (0, 4)), ("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
plan_query("in_list", R.Filter(PART, in_list(Ref(4), (1, 5, 9)), (0,)), ("p_partkey",), "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
#: A nullable column: sizes above 25 are null.
NULLABLE = project(PART, Ref(0), E.Case(((Ref(4) <= 25, Ref(4)),)))
_NULLABLE = "(SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_size END AS v FROM part)"
plan_query("is_null", R.Filter(NULLABLE, IsNull(Ref(1)), (0,)), ("p_partkey",), f"SELECT p_partkey FROM {_NULLABLE} WHERE v IS NULL")
plan_query("is_not_null", R.Filter(NULLABLE, ~IsNull(Ref(1))), ("p_partkey", "v"), f"SELECT p_partkey, v FROM {_NULLABLE} WHERE v IS NOT NULL")
plan_query("is_not_distinct", R.Filter(NULLABLE, Ref(1).same(Lit(None, "i32")), (0,)), ("p_partkey",), f"SELECT p_partkey FROM {_NULLABLE} WHERE v IS NOT DISTINCT FROM NULL")
plan_query("arith_types", project(PART, Ref(0), Ref(4) + Ref(4), Ref(4) - 7, Ref(4) * Ref(4), Ref(4) * Ref(5)), ("p_partkey", "a", "b", "c", "d"), "SELECT p_partkey, p_size::BIGINT + p_size AS a, p_size::BIGINT - 7 AS b, p_size::BIGINT * p_size AS c, p_size * p_retailprice AS d FROM part")
plan_query("true_division", project(PART, Ref(0), Ref(4) / 7), ("p_partkey", "q"), "SELECT p_partkey, p_size::DOUBLE / 7 AS q FROM part")
plan_query("division_by_zero", project(PART, Ref(0), Ref(4) / (Ref(4) - Ref(4))), ("p_partkey", "q"), "SELECT p_partkey, CASE WHEN p_size = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS q FROM part")
plan_query("case_when", project(PART, Ref(0), E.Case(((Ref(4) < 10, Lit("small")), (Ref(4) < 30, Lit("medium"))), Lit("large"))), ("p_partkey", "c"), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c FROM part")
plan_query("cast_numeric", project(PART, Cast(Ref(4), "i64"), Cast(Ref(4), "f64"), Cast(Ref(0), "string")), ("a", "b", "c"), "SELECT p_size::BIGINT AS a, p_size::DOUBLE AS b, p_partkey::VARCHAR AS c FROM part")
for _name, _like, _not in (("like_prefix", "small%", False), ("like_suffix", "%ring", False), ("like_middle", "%l% r%", False), ("like_underscore", "_mall%", False), ("not_like", "small%", True)):
    _c = Like(Ref(1), _like)
    plan_query(_name, R.Filter(PART, ~_c if _not else _c, (0, 1)), ("p_partkey", "p_name"), f"SELECT p_partkey, p_name FROM part WHERE p_name {'NOT ' * _not}LIKE '{_like}'")
plan_query("like_escape", R.Filter(PART, Like(Ref(2), "Brand!#_", "!"), (0, 2)), ("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_'")
plan_query("ilike", R.Filter(PART, Like(Ref(1), "SMALL%", ignore_case=True), (0, 1)), ("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%'")
plan_query("substring", project(PART, Ref(0), Substring(Ref(1), 2, 3)), ("p_partkey", "s"), "SELECT p_partkey, substring(p_name, 2, 3) AS s FROM part")
plan_query("round", project(PART, Ref(0), Round(Ref(5), 0)), ("p_partkey", "r"), "SELECT p_partkey, round(p_retailprice, 0) AS r FROM part")
for _part, _sql in (("year", "year"), ("month", "month"), ("day", "day"), ("weekday", "isodow"), ("hour", "hour"), ("minute", "minute"), ("second", "second")):
    plan_query(f"date_part_{_part}", project(EVENTS, Ref(0), DatePart(_part, Ref(1))), ("event_id", "p"), f"SELECT event_id, date_part('{_sql}', ts)::SMALLINT AS p FROM events")
plan_query("date_part_millisecond", project(EVENTS, Ref(0), DatePart("millisecond", Ref(1))), ("event_id", "p"), "SELECT event_id, (date_part('millisecond', ts)::BIGINT % 1000)::SMALLINT AS p FROM events")
plan_query("date_part_microsecond", project(EVENTS, Ref(0), DatePart("microsecond", Ref(1))), ("event_id", "p"), "SELECT event_id, (date_part('microsecond', ts)::BIGINT % 1000)::SMALLINT AS p FROM events")
# Spark keeps microseconds: the nanoseconds within one are always 0
plan_query("date_part_nanosecond", project(EVENTS, Ref(0), DatePart("nanosecond", Ref(1))), ("event_id", "p"), "SELECT event_id, (epoch_ns(ts) % 1000)::SMALLINT AS p FROM events")
plan_query("cast_date", project(ORDERS, Ref(0), Cast(Ref(2), "date")), ("o_orderkey", "d"), "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")

# --- joins ---------------------------------------------------------------------------------------

_ON = Ref(2).eq(Ref(3))
_FEW = R.Filter(REGION, Ref(0) < 3)
_NR = ("n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name")
_FEWSQL = "(SELECT * FROM region WHERE r_regionkey < 3)"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):
    plan_query(f"join_{_how}", R.Join(NATION, _FEW, _ON, _how), _NR, f"SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation {_sql} {_FEWSQL} r ON n_regionkey = r_regionkey")
plan_query("join_single", R.Join(NATION, _FEW, _ON, "single"), _NR, f"SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation LEFT JOIN {_FEWSQL} r ON n_regionkey = r_regionkey")
plan_query("join_single_projected", R.Join(NATION, _FEW, _ON, "single", (1, 4)), ("n_name", "r_name"), f"SELECT n_name, r_name FROM nation LEFT JOIN {_FEWSQL} r ON n_regionkey = r_regionkey")
plan_query("join_side_filters", R.Join(NATION, REGION, _ON, "left", left_filter=Ref(0) > 4, right_filter=Ref(0) < 3), _NR, f"SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM (SELECT * FROM nation WHERE n_nationkey > 4) n LEFT JOIN {_FEWSQL} r ON n_regionkey = r_regionkey")
_ORDERS_OF = read("orders", "o_orderkey", "o_custkey")
_BIG = Ref(0).eq(Ref(5))
plan_query("join_semi", R.Join(CUSTOMER, _ORDERS_OF, _BIG, "left_semi", (0,)), ("c_custkey",), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
plan_query("join_anti", R.Join(CUSTOMER, _ORDERS_OF, _BIG, "left_anti", (0,)), ("c_custkey",), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
plan_query("join_cross", R.Join(NATION, REGION, Lit(True), "cross"), _NR, "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation CROSS JOIN region")
plan_query("join_theta", R.Join(NATION, REGION, Ref(2) > Ref(3)), _NR, "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
for _how, _sql in (("left", "LEFT JOIN"), ("full", "FULL JOIN")):
    plan_query(f"join_theta_{_how}", R.Join(NATION, _FEW, Ref(2) < Ref(3), _how), _NR, f"SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation {_sql} {_FEWSQL} r ON n_regionkey < r_regionkey")
    plan_query(f"join_mixed_{_how}", R.Join(SUPPLIER, CUSTOMER, Ref(1).eq(Ref(4)) & (Ref(2) < Ref(5)) & (Ref(5) > 9000.0), _how, (0, 3)), ("s_suppkey", "c_custkey"), f"SELECT s_suppkey, c_custkey FROM supplier {_sql} customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal AND c_acctbal > 9000.0")
plan_query("join_mixed", R.Join(SUPPLIER, CUSTOMER, Ref(1).eq(Ref(4)) & (Ref(2) > Ref(5)), "inner", (0, 3)), ("s_suppkey", "c_custkey"), "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
for _how, _neg in (("left_semi", ""), ("left_anti", "NOT ")):
    plan_query(f"join_mixed_{_how[5:]}", R.Join(SUPPLIER, CUSTOMER, Ref(1).eq(Ref(4)) & (Ref(2) > Ref(5) + 9000.0), _how), ("s_suppkey", "s_nationkey", "s_acctbal"), f"SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE {_neg}EXISTS (SELECT 1 FROM customer WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000.0)")
    plan_query(f"join_theta_{_how[5:]}", R.Join(NATION, _FEW, Ref(2) < Ref(3), _how), ("n_nationkey", "n_name", "n_regionkey"), f"SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE {_neg}EXISTS (SELECT 1 FROM {_FEWSQL} r WHERE n_regionkey < r_regionkey)")
#: The whole nullable table, its nulls included, with one row for each value.
_PER_VALUE = R.Aggregate(NULLABLE, (Ref(1),), (("count_all", None),))
plan_query("join_null_safe", R.Join(NULLABLE, _PER_VALUE, Ref(1).same(Ref(2)), "inner", (0, 1, 3)), ("p_partkey", "v", "n"), f"SELECT x.p_partkey, x.v, y.n FROM {_NULLABLE} x JOIN (SELECT v, count(*) AS n FROM {_NULLABLE} GROUP BY v) y ON x.v IS NOT DISTINCT FROM y.v")
plan_query("join_self", R.Join(NATION, NATION, Ref(2).eq(Ref(5)) & (Ref(0) < Ref(3)), "inner", (0, 3)), ("a", "b"), "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
for _hint in ("broadcast_right", "broadcast_left", "shuffle"):
    plan_query(f"join_{_hint}_hint", R.Join(ORDERS, CUSTOMER, Ref(1).eq(Ref(5)), "inner", (0, 8), hint=_hint), ("o_orderkey", "c_mktsegment"), "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
#: One small side for two joins; Spark builds and ships it once.
_NAMED = R.Filter(NATION, Ref(0) < 20)
_TWICE = R.SetOp("union_all", R.Join(SUPPLIER, _NAMED, Ref(1).eq(Ref(3)), "inner", (0, 4), "broadcast_right"), R.Join(CUSTOMER, _NAMED, Ref(1).eq(Ref(4)), "inner", (0, 5), "broadcast_right"))
plan_query("join_reused_build", _TWICE, ("k", "n_name"), "SELECT s_suppkey AS k, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 20 UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20")
#: All partitions gathered into one; for small tables only.
plan_query("concatenate", R.Shuffle(R.SetOp("union_all", NATION, NATION), (), 1), _NR[:3], "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
plan_query("shuffle_by_key", R.Shuffle(SUPPLIER, (1,)), ("s_suppkey", "s_nationkey", "s_acctbal"), "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")

# --- aggregates ----------------------------------------------------------------------------------

_KEY = Ref(2)
_ARGS = {"sum": ("sum", Ref(4), "sum(p_size)::BIGINT"), "avg": ("avg", Ref(4), "avg(p_size)"), "min": ("min", Ref(5), "min(p_retailprice)"), "max": ("max", Ref(5), "max(p_retailprice)"), "count_star": ("count_all", None, "count(*)"), "sum_sq": ("sum_of_squares", Ref(4), "sum(p_size::BIGINT * p_size)::BIGINT"), "median": ("median", Ref(4), "median(p_size)"), "bool_and": ("all", Ref(4) > 1, "bool_and(p_size > 1)"), "bool_or": ("any", Ref(4) > 49, "bool_or(p_size > 49)"), "count_distinct": ("count_distinct", Ref(4), "count(DISTINCT p_size)"), "sum_with_overflow": ("sum_with_overflow", Ref(4), "sum(p_size)::BIGINT")}
for _name, (_kind, _arg, _sql) in _ARGS.items():
    plan_query(f"agg_{_name}", R.Aggregate(PART, (_KEY,), ((_kind, _arg),)), ("p_brand", "v"), f"SELECT p_brand, {_sql} AS v FROM part GROUP BY p_brand")
for _name, _kind, _sql in (("stddev", "stddev", "stddev_samp(p_size)"), ("variance", "variance", "var_samp(p_size)"), ("m2", "m2", "var_pop(p_size) * count(p_size)")):
    _agg = R.Aggregate(PART, (_KEY,), ((_kind, Ref(4)),))
    plan_query(f"agg_{_name}", project(_agg, Ref(0), Round(Ref(1), 6)), ("p_brand", "v"), f"SELECT p_brand, round({_sql}, 6) AS v FROM part GROUP BY p_brand")
plan_query("agg_count_col", R.Aggregate(NULLABLE, (), (("count_valid", Ref(1)), ("count_all", None))), ("n", "m"), f"SELECT count(v) AS n, count(*) AS m FROM {_NULLABLE}")
plan_query("agg_product", R.Aggregate(NATION, (Ref(2),), (("product", Ref(0) + 1),)), ("n_regionkey", "v"), "SELECT n_regionkey, product(n_nationkey + 1)::BIGINT AS v FROM nation GROUP BY n_regionkey")
#: Which row of a group has the least or the greatest price; the row id is then looked up in the same rows.
_ROWS = R.RowId(R.Project(PART, (Ref(0), Ref(2), Ref(5))))
for _kind, _dir in (("argmin", "ASC"), ("argmax", "DESC")):
    _place = R.Aggregate(_ROWS, (Ref(1),), ((_kind, Ref(2) * 1000000 + Ref(0)),))
    plan_query(f"agg_{_kind}", R.Join(_place, _ROWS, Ref(1).eq(Ref(5)), "inner", (0, 2)), ("p_brand", "v"), f"SELECT p_brand, arg_{_kind[3:]}(p_partkey, p_retailprice * 1000000 + p_partkey) AS v FROM part GROUP BY p_brand")
plan_query("agg_global", R.Aggregate(PART, (), (("sum", Ref(4)), ("min", Ref(4)), ("max", Ref(4)), ("count_all", None))), ("s", "lo", "hi", "n"), "SELECT sum(p_size)::BIGINT AS s, min(p_size) AS lo, max(p_size) AS hi, count(*) AS n FROM part")
plan_query("agg_global_empty", R.Aggregate(R.Filter(PART, Lit(False)), (), (("sum", Ref(4)), ("count_all", None))), ("s", "n"), "SELECT sum(p_size)::BIGINT AS s, count(*) AS n FROM part WHERE false")
plan_query("agg_masked", R.Aggregate(PART, (_KEY,), (("sum", Ref(4)), ("count_all", None)), Ref(4) > 25), ("p_brand", "s", "n"), "SELECT p_brand, sum(p_size)::BIGINT AS s, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand")
plan_query("agg_null_group", R.Aggregate(NULLABLE, (Ref(1),), (("count_all", None),)), ("v", "n"), f"SELECT v, count(*) AS n FROM {_NULLABLE} GROUP BY v")
plan_query("agg_having", R.Filter(R.Aggregate(PART, (_KEY,), (("sum", Ref(4)),)), Ref(1) > 2000), ("p_brand", "s"), "SELECT p_brand, sum(p_size)::BIGINT AS s FROM part GROUP BY p_brand HAVING sum(p_size) > 2000")
plan_query("agg_multi_key", R.Aggregate(PART, (Ref(2), Ref(3)), (("count_all", None), ("avg", Ref(4)))), ("p_brand", "p_type", "n", "a"), "SELECT p_brand, p_type, count(*) AS n, avg(p_size) AS a FROM part GROUP BY p_brand, p_type")
plan_query("agg_expr_key", R.Aggregate(PART, (Ref(4) * 2,), (("count_all", None),)), ("k", "n"), "SELECT p_size::BIGINT * 2 AS k, count(*) AS n FROM part GROUP BY k")
plan_query("agg_distinct_rows", R.Aggregate(PART, (Ref(2), Ref(3)), ()), ("p_brand", "p_type"), "SELECT DISTINCT p_brand, p_type FROM part")
sql_query("agg_filter_where", "SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS n FROM {part} GROUP BY p_brand")
sql_query("agg_grouping_sets", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
sql_query("agg_rollup", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY ROLLUP (p_brand, p_type)")
sql_query("agg_cube", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY CUBE (p_brand, p_type)")


def agg_approx_distinct_close(spark, sf_dir):
    """The sketch and the exact count are made apart: in one aggregate, Spark keeps a sketch for each distinct key."""
    keys = Tables(spark, sf_dir)("lineitem").select("l_partkey")
    sketch = keys.agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"))
    exact = keys.distinct().agg(F.count("l_partkey").alias("exact"))
    return sketch.join(exact).select((F.abs(F.col("approx") - F.col("exact")) <= 0.08 * F.col("exact")).alias("close"))


add("agg_approx_distinct_close", agg_approx_distinct_close, "SELECT true AS close")
add("agg_approx_distinct", lambda s, d: Tables(s, d)("lineitem").agg(F.approx_count_distinct("l_partkey").alias("n")), None)

# --- windows -------------------------------------------------------------------------------------

_W = read("orders", "o_orderkey", "o_custkey", "o_totalprice")
_BY = ((Ref(0), True, True),)
_WC = ("o_orderkey", "o_custkey", "o_totalprice", "v")
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
for _f, _sql in (("rank", "rank()"), ("dense_rank", "dense_rank()"), ("row_number", "row_number()")):
    _p = R.Window(_W, _f, (), ((Ref(2), False, False), (Ref(0), True, True)) if _f == "row_number" else ((Ref(2), False, False),), (Ref(1),))
    plan_query(f"window_{_f}", project(_p, Ref(0), Ref(1), Ref(2), Cast(Ref(3), "i64")), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, {_sql} OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC{', o_orderkey' * (_f == 'row_number')}) AS v FROM orders")
for _f, _kind, _arg, _sql in (("sum_running", "sum", Ref(0), "sum(o_orderkey)"), ("min", "min", Ref(2), "min(o_totalprice)"), ("max", "max", Ref(2), "max(o_totalprice)"), ("count", "count_all", None, "count(*)"), ("count_col", "count_valid", Ref(2), "count(o_totalprice)")):
    plan_query(f"window_{_f}", R.Window(_W, _kind, () if _arg is None else (_arg,), _BY, (Ref(1),)), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, {_sql if not _sql.startswith('sum') else _sql} {_OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW){'::BIGINT' * _sql.startswith('sum')} AS v FROM orders")
for _f, _sql in (("avg", "avg"), ("stddev", "stddev_samp"), ("variance", "var_samp")):
    plan_query(f"window_{_f}", project(R.Window(_W, _f, (Ref(0),), _BY, (Ref(1),)), Ref(0), Ref(1), Ref(2), Round(Ref(3), 3)), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, round({_sql}(o_orderkey) {_OVER}), 3) AS v FROM orders")
plan_query("window_sum_partition", R.Window(_W, "sum", (Ref(0),), (), (Ref(1),)), _WC, "SELECT o_orderkey, o_custkey, o_totalprice, sum(o_orderkey) OVER (PARTITION BY o_custkey)::BIGINT AS v FROM orders")
plan_query("window_null_partition", R.Window(NULLABLE, "count_all", (), (), (Ref(1),)), ("p_partkey", "v", "n"), f"SELECT p_partkey, v, count(*) OVER (PARTITION BY v) AS n FROM {_NULLABLE}")
for _up in (True, False):
    for _first in (True, False):
        _name, _sql = f"window_order_{'asc' if _up else 'desc'}_nulls_{'first' if _first else 'last'}", f"{'ASC' if _up else 'DESC'} NULLS {'FIRST' if _first else 'LAST'}"
        _w = R.Window(project(PART, Ref(0), Ref(2), E.Case(((Ref(4) <= 25, Ref(4)),))), "rank", (), ((Ref(2), _up, _first), (Ref(0), True, True)), (Ref(1),))
        plan_query(_name, project(_w, Ref(0), Ref(1), Ref(2), Cast(Ref(3), "i64")), ("p_partkey", "p_brand", "v", "r"), f"SELECT p_partkey, p_brand, v, rank() OVER (PARTITION BY p_brand ORDER BY v {_sql}, p_partkey) AS r FROM (SELECT p_partkey, p_brand, CASE WHEN p_size <= 25 THEN p_size END AS v FROM part)")
plan_query("window_range_bounded", R.Window(_W, "sum", (Ref(0),), _BY, (Ref(1),), -500, 500), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, sum(o_orderkey) {_OVER} RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)::BIGINT AS v FROM orders")
plan_query("window_rows_bounded", R.Window(_W, "sum", (Ref(0),), _BY, (Ref(1),), -1, 1, "rows"), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, sum(o_orderkey) {_OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS v FROM orders")
plan_query("window_lag", R.Window(_W, "lag", (Ref(2),), _BY, (Ref(1),)), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) {_OVER}) AS v FROM orders")
plan_query("window_lead", R.Window(_W, "lead", (Ref(2), Lit(2)), _BY, (Ref(1),)), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, lead(o_totalprice, 2) {_OVER}) AS v FROM orders")
plan_query("window_ntile", project(R.Window(_W, "ntile", (Lit(3),), _BY, (Ref(1),)), Ref(0), Ref(1), Ref(2), Cast(Ref(3), "i64")), _WC, f"SELECT o_orderkey, o_custkey, o_totalprice, ntile(3) {_OVER}) AS v FROM orders")
add("row_id_unique", lambda s, d: Tables(s, d)("orders").withColumn("i", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.count_distinct("i").alias("m")), "SELECT count(*) AS n, count(*) AS m FROM orders")

# --- order, limit, sets --------------------------------------------------------------------------

def ranked(spark, sf_dir, plan, names: tuple):
    """A sorted plan's whole output with ``rank``, each row's place in it from 1; no task holds all rows."""
    at = F.monotonically_increasing_id()
    rows = written(run(spark, sf_dir, plan, names).withColumn("_at", at), "sorted")  # the order's bounds are sampled once
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    first = spark.createDataFrame(before, "_part bigint, _before bigint")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("_part", part).join(F.broadcast(first), "_part").select(*names, place.alias("rank"))


for _name, _up, _first, _sql in (("sort_asc_nulls_last", True, False, "ASC NULLS LAST"), ("sort_asc_nulls_first", True, True, "ASC NULLS FIRST"), ("sort_desc_nulls_last", False, False, "DESC NULLS LAST"), ("sort_desc_nulls_first", False, True, "DESC NULLS FIRST")):
    _sorted = R.Sort(NULLABLE, ((Ref(1), _up, _first), (Ref(0), True, True)))
    add(_name, lambda s, d, p=_sorted: ranked(s, d, p, ("p_partkey", "v")), f"SELECT p_partkey, v, row_number() OVER (ORDER BY v {_sql}, p_partkey) AS rank FROM {_NULLABLE}")
plan_query("limit_offset", R.Fetch(R.Sort(_W, ((Ref(0), True, True),)), 5, 10), _WC[:3], "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
plan_query("offset_only", R.Fetch(R.Sort(NATION, ((Ref(0), True, True),)), 20), _NR[:3], "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey OFFSET 20")
plan_query("offset_past_end", R.Fetch(NATION, 1000, 5), _NR[:3], "SELECT n_nationkey, n_name, n_regionkey FROM nation LIMIT 5 OFFSET 1000")
plan_query("topk", R.Fetch(R.Sort(_W, ((Ref(2), False, False), (Ref(0), True, True))), 0, 25), _WC[:3], "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_A = project(CUSTOMER, Ref(1))
_B = project(R.Filter(SUPPLIER, Ref(2) > 5000.0), Ref(1))
_ASQL, _BSQL = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000.0"
for _name, _kind, _sql in (("union_all", "union_all", "UNION ALL"), ("union_distinct", "union", "UNION"), ("intersect", "intersect", "INTERSECT"), ("except", "minus", "EXCEPT"), ("intersect_all", "intersect_all", "INTERSECT ALL"), ("except_all", "minus_all", "EXCEPT ALL")):
    plan_query(_name, R.SetOp(_kind, _A, _B), ("k",), f"{_ASQL} {_sql} {_BSQL}")

# --- subqueries, views, DDL, user-defined relations, storage -------------------------------------

plan_query("in_subquery", R.Filter(CUSTOMER, E.InSubquery(Ref(1), 0), (0,), (R.Filter(SUPPLIER, Ref(2) > 9000.0, (1,)),)), ("c_custkey",), "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000.0)")
sql_query("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000.0)")
sql_query("exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
sql_query("not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
sql_query("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM {orders})")


def _engine(spark, sf_dir, *tables) -> Engine:
    engine = Engine(spark)
    for t in tables:
        engine.catalog.register_frame(t, Tables(spark, sf_dir)(t))
    return engine


def copy_roundtrip(spark, sf_dir):
    engine = Engine(spark)
    engine.run_script(f"CREATE OR REPLACE TABLE nation_copy (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR, n_regionkey BIGINT NOT NULL); COPY nation_copy FROM '{sf_dir}/nation.parquet' (FORMAT parquet); COPY nation_copy FROM '{sf_dir}/nation.parquet'")
    return engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation_copy")


def ddl_external_table(spark, sf_dir):
    engine = Engine(spark)
    engine.sql(f"CREATE EXTERNAL TABLE region_at (r_regionkey BIGINT, r_name VARCHAR) STORED AS PARQUET LOCATION '{sf_dir}/region.parquet'")
    return engine.sql("SELECT r_regionkey, r_name FROM region_at")


def view_in_script(spark, sf_dir):
    engine = _engine(spark, sf_dir, "supplier")
    return engine.run_script("CREATE VIEW rich AS SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000.0; SELECT s_nationkey, count(*) AS n FROM rich GROUP BY s_nationkey")


def show_all_options(spark, sf_dir):
    return Engine(spark).sql("SHOW ALL")


def _keep_large(batch: pa.RecordBatch) -> pa.RecordBatch:
    import pyarrow.compute as pc

    return batch.filter(pc.greater(batch.column(1), 45))


def udr_map_in_arrow(spark, sf_dir):
    plan = udr.relation(udr.optional_transform(_keep_large, "p_partkey bigint, p_size int"), read("part", "p_partkey", "p_size"))
    return Engine.run_plan(_engine(spark, sf_dir, "part"), plan)


def udr_fold(spark, sf_dir):
    import numpy as np

    def more(state, batch):
        x = batch.column(0).to_numpy(zero_copy_only=False)
        return state[0] + len(x), state[1] + int(x.sum()), state[2] + int((x.astype(np.int64) ** 2).sum())

    step = udr.fold(lambda: (0, 0, 0), more, lambda s: pa.RecordBatch.from_arrays([pa.array([v]) for v in s], names=["n", "s", "q"]), "n bigint, s bigint, q bigint", lambda df: df.agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]))
    return Engine.run_plan(_engine(spark, sf_dir, "part"), udr.relation(step, read("part", "p_size")))


def zone_pruning(spark, sf_dir):
    df = Tables(spark, sf_dir)("orders").select("o_orderkey", "o_totalprice")
    zones = P.zone_map(df, F.floor(F.col("o_orderkey") / 1000).cast("bigint"))
    return P.pruned_zones(zones, ["o_orderkey", "o_totalprice"], (Ref(0) >= 4500) & (Ref(0) < 9500)).select("zone", "rows", "o_orderkey_min", "o_orderkey_max")


add("copy_roundtrip", copy_roundtrip, "SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey::BIGINT FROM nation")
add("ddl_external_table", ddl_external_table, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
add("view_in_script", view_in_script, "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000.0 GROUP BY s_nationkey")
add("show_all_options", show_all_options, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{option_text(v)}')" for n, v in DEFAULTS.items()) + ") AS t(name, value)")
add("udr_map_in_arrow", udr_map_in_arrow, "SELECT p_partkey, p_size FROM part WHERE p_size > 45")
add("udr_fold", udr_fold, "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, sum(p_size::BIGINT * p_size)::BIGINT AS q FROM part")
add("zone_pruning", zone_pruning, "SELECT o_orderkey // 1000 AS zone, count(*) AS rows, min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max FROM orders GROUP BY zone HAVING max(o_orderkey) >= 4500 AND min(o_orderkey) < 9500")


def zone_pruned_scan(spark, sf_dir):
    path = fresh_path(spark, "zoned")
    P.write_zoned(Tables(spark, sf_dir)("orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", 16)
    return P.read_zoned(spark, path, (Ref(0) >= 4500) & (Ref(0) < 9500) & (Ref(2) > 100000.0))


def zone_pruned_plan(spark, sf_dir):
    """A filter in a plan over a zoned table; the rules move it into the read, and the catalog's zones decide what is read."""
    engine, path = Engine(spark), fresh_path(spark, "zoned")
    P.write_zoned(Tables(spark, sf_dir)("orders"), path, "o_orderkey", 16)
    engine.catalog.register_zoned("zoned_orders", path)
    engine.sql("SET use_partition_pruning = true")
    return engine.run_plan(R.Aggregate(R.Filter(R.Read("zoned_orders", ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")), (Ref(0) < 2000) & (Ref(2) > 1000.0)), (Ref(3),), (("count_all", None), ("max", Ref(0))))).toDF("o_orderstatus", "n", "last")


def partition_file_filter(spark, sf_dir):
    path = fresh_path(spark, "by_region")
    Tables(spark, sf_dir)("nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey")).write.partitionBy("n_regionkey").parquet(path)
    wanted = Tables(spark, sf_dir)("region").where("r_name LIKE 'A%'").select("r_regionkey")
    return P.read_partitions(spark, path, T.StructType.fromDDL("n_nationkey INT, n_name STRING, n_regionkey BIGINT"), "n_regionkey", wanted)


def write_task(spark, sf_dir):
    path = fresh_path(spark, "files")
    P.write_files(Tables(spark, sf_dir)("supplier").select("s_suppkey", "s_nationkey"), path, 3, codec="zstd")
    return spark.read.parquet(path)


def snapshot(spark, sf_dir):
    engine, path = _engine(spark, sf_dir, "customer"), fresh_path(spark, "snapshot")
    engine.catalog.save("customer", path)
    other = Engine(spark)
    other.catalog.load("customer_again", path, unique_keys=[("c_custkey",)])
    return other.sql("SELECT c_custkey, c_mktsegment FROM customer_again")


def storage_kinds(spark, sf_dir):
    """A table of each memory kind, filled in two goes, and one of files."""
    engine, out = Engine(spark), None
    kinds = {"system_memory": "", "device_memory": ", device_id = 0", "numa_memory": ", numa_node_set = ARRAY[0], page_kind = 'small'"}
    for i, (kind, more) in enumerate(kinds.items()):
        engine.run_script(f"DROP TABLE IF EXISTS kept_{i}; CREATE TABLE kept_{i} (r_regionkey BIGINT, r_name VARCHAR) WITH (storage_kind = '{kind}'{more}); COPY kept_{i} FROM '{sf_dir}/region.parquet'; COPY kept_{i} FROM '{sf_dir}/region.parquet'")
        part = engine.sql(f"SELECT '{kind}' AS kind, r_regionkey, r_name FROM kept_{i}")
        out = part if out is None else out.unionByName(part)
    engine.run_script(f"CREATE EXTERNAL TABLE kept_files (r_regionkey BIGINT, r_name VARCHAR) STORED AS PARQUET LOCATION '{fresh_path(spark, 'table')}'; COPY kept_files FROM '{sf_dir}/region.parquet'")
    return out.unionByName(engine.sql("SELECT 'parquet_file' AS kind, r_regionkey, r_name FROM kept_files"))


def list_tables(spark, sf_dir):
    """SHOW TABLES after a DROP; row counts are those that COPY wrote."""
    engine = Engine(spark)
    engine.run_script(f"CREATE TABLE listed (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR); CREATE TABLE gone (x INTEGER); DROP TABLE gone; DROP TABLE IF EXISTS gone; COPY listed FROM '{sf_dir}/nation.parquet'")
    return engine.sql("SHOW TABLES").select("table_name", "storage_kind", "row_count", "unique_keys")


def result_sink(spark, sf_dir):
    engine, path = _engine(spark, sf_dir, "supplier"), fresh_path(spark, "result")
    engine.write_result(engine.sql("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey"), path)
    return spark.read.parquet(path)


def write_relation(spark, sf_dir):
    engine = _engine(spark, sf_dir, "supplier")
    engine.run_script("DROP TABLE IF EXISTS rich_suppliers; CREATE TABLE rich_suppliers (s_suppkey INTEGER, s_nationkey INTEGER, s_acctbal DOUBLE)")
    return engine.run_plan(R.Write(R.Filter(SUPPLIER, Ref(2) > 5000.0), "rich_suppliers"))


def plan_file(spark, sf_dir):
    """A plan kept as JSON in a file, and run from it."""
    import json

    path = fresh_path(spark, "plan")
    plan = R.Aggregate(R.Filter(PART, Ref(4) > 25), (Ref(2),), (("count_all", None), ("avg", Ref(4))))
    spark.createDataFrame([(json.dumps(R.to_dict(plan)),)], "value string").coalesce(1).write.text(path)
    return _engine(spark, sf_dir, "part").run_plan_file(path).toDF("p_brand", "n", "a")


def job(spark, sf_dir):
    path = fresh_path(spark, "job")
    Engine(spark).run_job({"sql": "SELECT n_name, r_name FROM job_nation JOIN job_region ON n_regionkey = r_regionkey", "tables": {"job_nation": {"file": f"{sf_dir}/nation.parquet"}, "job_region": {"file": f"{sf_dir}/region.parquet"}}, "output": path})
    return spark.read.parquet(path)


def scalar_udf(spark, sf_dir):
    engine = _engine(spark, sf_dir, "part")
    engine.register_function("lode_scaled", lambda size, price: size * price, "double")
    return engine.sql("SELECT p_partkey, lode_scaled(p_size, p_retailprice) AS x FROM part")


def udr_iterate(spark, sf_dir):
    """Each nation unfolds to as many rows as its key says, at most four in a batch."""

    def start(batch):
        return [(k, 0) for k in batch.column(0).to_pylist()]

    def advance(state):
        state = [(k, i) for k, i in state if i < k]
        if not state:
            return None
        (k, i), rest = state[0], state[1:]
        n = min(k, i + 4)
        return pa.RecordBatch.from_arrays([pa.array([k] * (n - i), pa.int32()), pa.array(range(i, n), pa.int32())], names=["n_nationkey", "i"]), [(k, n), *rest]

    return udr.iterate(start, advance, "n_nationkey int, i int")(Tables(spark, sf_dir)("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey")))


def udr_stateful(spark, sf_dir):
    """Each customer's running number of orders; the state is the last customer and its count."""

    def advance(state, batch):
        out = []
        for c in batch.column(0).to_pylist():
            state = (c, state[1] + 1 if c == state[0] else 1)
            out.append(state[1])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["o_custkey", "o_orderkey", "n"]), state

    rows = Tables(spark, sf_dir)("orders").select(F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return udr.stateful_transform(lambda: (None, 0), advance, "o_custkey bigint, o_orderkey bigint, n bigint")(rows.repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey"))


add("zone_pruned_scan", zone_pruned_scan, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 4500 AND o_orderkey < 9500 AND o_totalprice > 100000.0")
add("zone_pruned_plan", zone_pruned_plan, "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderkey < 2000 AND o_totalprice > 1000.0 GROUP BY o_orderstatus")
add("partition_file_filter", partition_file_filter, "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
add("write_task", write_task, "SELECT s_suppkey, s_nationkey FROM supplier")
add("snapshot", snapshot, "SELECT c_custkey, c_mktsegment FROM customer")
add("storage_kinds", storage_kinds, "SELECT kind, r_regionkey::BIGINT AS r_regionkey, r_name FROM region, (VALUES ('system_memory'), ('system_memory'), ('device_memory'), ('device_memory'), ('numa_memory'), ('numa_memory'), ('parquet_file')) AS k(kind)")
add("list_tables", list_tables, "SELECT 'listed' AS table_name, 'boost_shared_memory' AS storage_kind, count(*) AS row_count, '[[\"n_nationkey\"]]' AS unique_keys FROM nation")
add("result_sink", result_sink, "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
add("write_relation", write_relation, "SELECT count(*) AS rows_affected FROM supplier WHERE s_acctbal > 5000.0")
add("plan_file", plan_file, "SELECT p_brand, count(*) AS n, avg(p_size) AS a FROM part WHERE p_size > 25 GROUP BY p_brand")
add("job", job, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("scalar_udf", scalar_udf, "SELECT p_partkey, p_size * p_retailprice AS x FROM part")
add("udr_iterate", udr_iterate, "SELECT n_nationkey::INTEGER AS n_nationkey, unnest(range(n_nationkey))::INTEGER AS i FROM nation")
add("udr_stateful", udr_stateful, "SELECT o_custkey::BIGINT AS o_custkey, o_orderkey::BIGINT AS o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
