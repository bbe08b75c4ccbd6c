"""TPC-H queries that the columns allow, and the operator shapes of the others. Tables stand in braces."""

from lodeframe.queries.registry import sql_query

_REVENUE = "sum(l_extendedprice * (1 - l_discount))"

sql_query("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

sql_query("tpch_q3_reduced", f"""
SELECT l_orderkey, round({_REVENUE}, 4) AS revenue, cast(o_orderdate AS date) AS o_orderdate
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1998-03-15 00:00:00' AND l_shipdate > timestamp '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")

sql_query("tpch_q5", f"""
SELECT n_name, round({_REVENUE}, 4) AS revenue
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= timestamp '1996-01-01 00:00:00' AND o_orderdate < timestamp '1998-01-01 00:00:00'
GROUP BY n_name""")

sql_query("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {lineitem}
WHERE l_shipdate >= timestamp '1996-01-01 00:00:00' AND l_shipdate < timestamp '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")

sql_query("tpch_q7", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS bigint) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey
  JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
) shipping GROUP BY supp_nation, cust_nation, l_year""")

sql_query("tpch_q8", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT cast(extract(year FROM o_orderdate) AS bigint) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey
  JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey
  JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY'
) all_nations GROUP BY o_year""")

sql_query("tpch_q10_reduced", f"""
SELECT c_custkey, c_name, round({_REVENUE}, 4) AS revenue, c_acctbal, n_name
FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= timestamp '1997-01-01 00:00:00' AND o_orderdate < timestamp '1998-01-01 00:00:00'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")

sql_query("tpch_q14", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE l_shipdate >= timestamp '1997-09-01 00:00:00' AND l_shipdate < timestamp '1998-10-01 00:00:00'""")

sql_query("tpch_q15", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round({_REVENUE}, 4) AS total_revenue FROM {{lineitem}}
  WHERE l_shipdate >= timestamp '1997-01-01 00:00:00' AND l_shipdate < timestamp '1997-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")

sql_query("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, cast(o_orderdate AS date) AS o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")

# The shapes of queries whose columns are missing here; they are not TPC-H results.
sql_query("shape_q2_min_per_key", """
SELECT s_suppkey, n_name, s_acctbal FROM {supplier} s JOIN {nation} n ON s_nationkey = n_nationkey
WHERE s_acctbal = (SELECT min(s2.s_acctbal) FROM {supplier} s2 WHERE s2.s_nationkey = s.s_nationkey)""")

sql_query("shape_q4_exists", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders} o
WHERE o_orderdate >= timestamp '1997-07-01 00:00:00' AND o_orderdate < timestamp '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate)
GROUP BY o_orderpriority""")

sql_query("shape_q9_profit", """
SELECT n_name, cast(extract(year FROM o_orderdate) AS bigint) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 4) AS profit
FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY n_name, o_year""", """
SELECT n_name, cast(extract(year FROM o_orderdate) AS bigint) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 4) AS profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY n_name, cast(extract(year FROM o_orderdate) AS bigint)""")

sql_query("shape_q11_share_of_total", """
SELECT l_partkey, round(sum(l_extendedprice * l_quantity), 2) AS val FROM {lineitem} GROUP BY l_partkey
HAVING sum(l_extendedprice * l_quantity) > (SELECT sum(l_extendedprice * l_quantity) * 0.001 FROM {lineitem})""")

sql_query("shape_q12_case_counts", """
SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS high_count,
  cast(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS low_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_linestatus""")

sql_query("shape_q13_left_count", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) c
GROUP BY c_count""")

sql_query("shape_q16_not_in", """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#2' AND p_type NOT LIKE 'ECO%' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size""")

sql_query("shape_q17_correlated_avg", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} l JOIN {part} ON p_partkey = l_partkey
WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = l.l_partkey)""")

sql_query("shape_q19_or_of_ands", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25)
   OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35)""")

sql_query("shape_q20_nested_in", """
SELECT s_suppkey, s_name FROM {supplier} WHERE s_suppkey IN (
  SELECT l_suppkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE 'small%') GROUP BY l_suppkey HAVING sum(l_quantity) > 300)""")

sql_query("shape_q21_exists_not_exists", """
SELECT s_suppkey, count(*) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_suppkey""")

sql_query("shape_q22_anti_join", """
SELECT substring(c_name, 10, 3) AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer} c
WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM {customer} c2 WHERE c2.c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey) GROUP BY substring(c_name, 10, 3)""")
