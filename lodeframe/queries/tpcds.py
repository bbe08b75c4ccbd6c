"""Shapes of the TPC-DS queries 3, 6, 7, 22, 38, 43 and 48 over the tables at hand; they are not TPC-DS results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.operators import udr
from lodeframe.plans.compile import compile_plan
from lodeframe.plans.relations import Read
from lodeframe.queries.registry import Tables, add, sql_query

_YEAR = "cast(extract(year FROM l_shipdate) AS bigint)"
_Q3 = f"""
SELECT {_YEAR} AS d_year, p_brand, round(sum(l_extendedprice), 2) AS sum_agg FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
WHERE extract(month FROM l_shipdate) = 11 AND p_type = 'ECONOMY' GROUP BY {_YEAR}, p_brand"""
sql_query("shape_ds_q3", _Q3)


def fused_q3(spark, sf_dir):
    """The same by a user-defined relation: one kernel filters by month, and sums by year and brand within its batches; the sums
    of all batches are added up by Spark. The join stays with Spark, which knows the sides' sizes."""

    def kernel(batches):
        sums: dict = {}
        for b in batches:
            day = b.column(0).to_numpy(zero_copy_only=False).astype("datetime64[M]").astype(np.int64)
            on = day % 12 == 10
            year, price = 1970 + day[on] // 12, b.column(1).to_numpy(zero_copy_only=False)[on]
            brand = np.array(b.column(2).to_pylist(), object)[on]
            names, at = np.unique([f"{y}\n{x}" for y, x in zip(year, brand, strict=True)], return_inverse=True)
            for name, s in zip(names, np.bincount(at, price, len(names)), strict=True):
                sums[name] = sums.get(name, 0.0) + s
        rows = [(int(k.split("\n")[0]), k.split("\n")[1], v) for k, v in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["d_year", "p_brand", "s"])

    def joined(line, part):
        rows = line.join(part.where("p_type = 'ECONOMY'"), line.l_partkey == part.p_partkey).select("l_shipdate", "l_extendedprice", "p_brand")
        return rows.mapInArrow(kernel, "d_year bigint, p_brand string, s double").groupBy("d_year", "p_brand").agg(F.round(F.sum("s"), 2).alias("sum_agg"))

    plan = udr.relation(joined, Read("lineitem", ("l_partkey", "l_shipdate", "l_extendedprice")), Read("part", ("p_partkey", "p_brand", "p_type")))
    return compile_plan(plan, Tables(spark, sf_dir))


add("udr_fused_q3", fused_q3, _Q3.replace("{", "").replace("}", ""))

sql_query("shape_ds_q6", """
SELECT c_nationkey, count(*) AS cnt FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} i ON l_partkey = i.p_partkey
WHERE extract(year FROM o_orderdate) = 1997 AND extract(month FROM o_orderdate) = 1 AND i.p_retailprice > 1.1 * (SELECT avg(j.p_retailprice) FROM {part} j WHERE j.p_type = i.p_type)
GROUP BY c_nationkey HAVING count(*) >= 2""")

sql_query("shape_ds_q7", """
SELECT p_brand, round(avg(l_quantity), 6) AS agg1, round(avg(l_extendedprice), 4) AS agg2, round(avg(l_discount), 6) AS agg3, round(avg(l_tax), 6) AS agg4
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND (l_returnflag = 'N' OR l_linestatus = 'O') AND extract(year FROM l_shipdate) = 1998 GROUP BY p_brand""")

sql_query("shape_ds_q22", """
SELECT p_brand, p_type, round(avg(l_quantity), 6) AS qoh FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE extract(year FROM l_shipdate) BETWEEN 1997 AND 1998 GROUP BY ROLLUP (p_brand, p_type)""")

sql_query("shape_ds_q38", """
SELECT count(*) AS n FROM (
  SELECT DISTINCT c_nationkey, o_orderpriority FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE extract(year FROM o_orderdate) = 1996 AND o_orderstatus = 'O'
  INTERSECT SELECT DISTINCT c_nationkey, o_orderpriority FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE extract(year FROM o_orderdate) = 1997 AND o_orderstatus = 'F'
  INTERSECT SELECT DISTINCT c_nationkey, o_orderpriority FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE extract(year FROM o_orderdate) = 1998 AND o_orderstatus = 'P') hot""")

_DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
_Q43 = "SELECT s_name, " + ", ".join(f"round(sum(CASE WHEN {{day}} = {i} THEN l_extendedprice END), 2) AS {d}_sales" for i, d in enumerate(_DAYS)) + " FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE s_nationkey = 5 AND extract(year FROM l_shipdate) = 2000 GROUP BY s_name"
sql_query("shape_ds_q43", _Q43.replace("{day}", "dayofweek(l_shipdate) - 1"), _Q43.replace("{day}", "dayofweek(l_shipdate)").replace("{", "").replace("}", ""))

sql_query("shape_ds_q48", """
SELECT sum(l_quantity) AS q FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE extract(year FROM o_orderdate) = 1999
  AND ((c_mktsegment = 'BUILDING' AND l_extendedprice BETWEEN 10000 AND 30000) OR (c_mktsegment = 'MACHINERY' AND l_extendedprice BETWEEN 5000 AND 20000) OR (c_mktsegment = 'HOUSEHOLD' AND l_extendedprice BETWEEN 15000 AND 40000))
  AND ((c_nationkey IN (1, 2, 3) AND o_totalprice BETWEEN 0 AND 200000) OR (c_nationkey IN (4, 5, 6) AND o_totalprice BETWEEN 150000 AND 300000) OR (c_nationkey IN (7, 8, 9) AND o_totalprice BETWEEN 50000 AND 250000))""")
