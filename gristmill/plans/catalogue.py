"""The catalogue of registered queries over the driver tables, each with SQL for DuckDB.

Plain queries are one text that both engines read alike; the rest is built with the library's helpers and
held against SQL written for DuckDB. Orders are total, computed columns are named and typed on both sides,
and NULLs are injected (``nullif``, outer joins, VALUES), since the tables hold none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans import catalogue_engine, catalogue_functions, catalogue_state
from gristmill.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def same(name: str, text: str) -> None:
    """A query whose text means the same in Spark and in DuckDB."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLE_SQL[name] = text


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
REVENUE = MONEY.format("l_extendedprice")

# scans, projections, predicates
same("scan_all", "SELECT r_regionkey, r_name FROM region")
same("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q1, -l_tax AS neg_tax FROM lineitem")
same("filter_eq", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey <> 7")
same("filter_range_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_discount < 0.05")
same("filter_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 14) AND NOT (p_partkey IN (3, 4))")
same("filter_like_escape", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%!%%' ESCAPE '!' AND p_brand LIKE 'Brand#_%'")
same("filter_3vl_and_or_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (nullif(l_returnflag, 'A') = 'R' OR nullif(l_linestatus, 'O') = 'F') AND (l_quantity > 5 OR nullif(l_returnflag, 'N') IS NULL)")
same("filter_is_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL AND nullif(o_orderpriority, '1-URGENT') IS NOT NULL")
same("filter_nulls_in_comparison", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'O') <> 'F' OR nullif(o_orderstatus, 'P') = nullif(o_orderstatus, 'F')")
same("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders")
same("case_simple", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS flag FROM lineitem")
same("cast_types", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size_big, CAST(p_size AS DOUBLE) AS size_double, CAST(p_partkey AS VARCHAR(20)) AS key_text, CAST(CAST(p_retailprice AS DECIMAL(38,12)) AS DOUBLE) AS price FROM part")
same("values_rows", "SELECT a, b, c FROM (VALUES (1, 'x', 1.5), (2, NULL, 2.5), (CAST(NULL AS INT), 'z', NULL)) AS v(a, b, c)")
same("count_star", "SELECT count(*) AS n FROM lineitem")
same("count_subquery", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 50000) AS s")
same("index_scan_order", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 4000 AND o_custkey > 10 ORDER BY o_orderkey DESC")
same("out_of_range_key", "SELECT count(*) AS n FROM region WHERE CAST(r_regionkey AS SMALLINT) < 100000 AND CAST(r_regionkey AS SMALLINT) > -100000")

# joins
same("join_inner_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
same("join_theta", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
same("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
same("join_left_prejoin", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
same("join_left_where_inner", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' OR o_orderkey IS NULL")
same("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
same("join_self", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
same("join_using", "SELECT k, x, y FROM (SELECT o_custkey AS k, o_orderkey AS x FROM orders) a JOIN (SELECT c_custkey AS k, c_name AS y FROM customer) b USING (k)")
same("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
same("join_three_way", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
same("join_five_way", f"SELECT r_name, n_name, {REVENUE} AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name")
same("join_null_keys", "SELECT count(*) AS n FROM (SELECT nullif(o_custkey % 5, 0) AS k FROM orders) a LEFT JOIN (SELECT DISTINCT nullif(c_custkey % 5, 0) AS k FROM customer) b ON a.k = b.k WHERE b.k IS NULL")
same("join_anti_idiom", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
same("join_derived_tables", "SELECT a.k, a.n, b.top FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.k = b.k WHERE a.n > 1")

# aggregates
same("agg_scalar", f"SELECT count(*) AS n, {REVENUE} AS total, min(l_shipdate) AS first_ship, max(l_comment_key) AS top FROM (SELECT *, l_orderkey * 10 + l_linenumber AS l_comment_key FROM lineitem) AS s")
same("agg_scalar_empty", "SELECT count(*) AS n, count(l_tax) AS c, CAST(sum(l_tax) AS DOUBLE) AS s, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_quantity < 0")
same("agg_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_quantity')} AS qty, {REVENUE} AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_group_expr", "SELECT p_size % 7 AS bucket, count(*) AS n, max(p_retailprice) AS hi FROM part GROUP BY p_size % 7")
same("agg_group_multi", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus, o_orderpriority")
same("agg_group_nulls", "SELECT nullif(l_returnflag, 'A') AS flag, count(*) AS n, count(nullif(l_linestatus, 'O')) AS c FROM lineitem GROUP BY nullif(l_returnflag, 'A')")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
same("agg_limit_offset", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 3 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 5")
same("agg_count_distinct", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT nullif(l_linenumber, 1)) AS numbers FROM lineitem")
same("agg_sum_distinct", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem")
same("agg_mixed_distinct", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_linenumber) AS d, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sd, CAST(sum(l_linenumber) AS BIGINT) AS s, min(DISTINCT l_quantity) AS lo FROM lineitem GROUP BY l_returnflag")
same("agg_expr_of_aggs", "SELECT o_orderstatus, CAST(sum(o_custkey + 1) AS BIGINT) AS s, (max(o_totalprice) - min(o_totalprice)) / count(*) AS spread FROM orders GROUP BY o_orderstatus")
same("agg_nested_subquery", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS s GROUP BY n")
same("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
same("distinct_of_group", "SELECT DISTINCT n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS s")
same("min_max_by_key", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")

# sorts and limits
same("order_multi_key", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey ASC, o_orderkey DESC")
same("order_expr_ordinal", "SELECT p_partkey, p_size % 10 AS m FROM part ORDER BY 2 DESC, p_retailprice * 2, 1")
same("order_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS FIRST, o_orderkey")
same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
same("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 10")

# set operations
_A, _B, _C = ("SELECT {} AS k FROM {}".format(*x) for x in (("o_custkey % 40", "orders"), ("c_custkey % 60", "customer"), ("CAST(n_nationkey AS BIGINT)", "nation")))
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    same(_name, f"{_A} {_op} {_B}")
same("setop_nested", f"({_A} EXCEPT {_C}) UNION ALL ({_B} INTERSECT ({_C} UNION {_A}))")
same("setop_nulls", "SELECT nullif(o_orderstatus, 'F') AS s FROM orders EXCEPT ALL SELECT nullif(l_linestatus, 'F') FROM lineitem WHERE l_linenumber = 1")
same("derived_table_depth", "SELECT k, n FROM (SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) x GROUP BY o_custkey) y WHERE n > 2) z")

# procedures of the example applications, on the driver tables
same("proc_winning_states", "SELECT n_nationkey, c_mktsegment, num FROM (SELECT c_nationkey, c_mktsegment, count(*) AS num FROM customer GROUP BY c_nationkey, c_mktsegment) v JOIN nation ON n_nationkey = c_nationkey ORDER BY n_nationkey, num DESC, c_mktsegment")
same("proc_max_value", "SELECT max(value) AS max_value FROM events")
same("proc_top_apps", "SELECT event_type, count(DISTINCT user_id) AS devices FROM events GROUP BY event_type ORDER BY devices DESC, event_type LIMIT 10")


def proc_voter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard: pre-aggregate the facts, join the dimension, order totally."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    by_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    joined = by_customer.join(customer, by_customer.o_custkey == customer.c_custkey)
    out = joined.groupBy("c_mktsegment").agg(F.sum("n").alias("n_orders"), F.sum("total").cast("double").alias("total_price"))
    return out.orderBy(F.desc("total_price"), "n_orders", "c_mktsegment")


QUERIES["proc_voter_results"] = proc_voter_results
ORACLE_SQL["proc_voter_results"] = f"SELECT c_mktsegment, count(*) AS n_orders, {MONEY.format('o_totalprice')} AS total_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"

QUERIES |= catalogue_functions.QUERIES | catalogue_state.QUERIES | catalogue_engine.QUERIES
ORACLE_SQL |= catalogue_functions.ORACLE_SQL | catalogue_state.ORACLE_SQL | catalogue_engine.ORACLE_SQL
