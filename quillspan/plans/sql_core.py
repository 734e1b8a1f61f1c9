"""SQL queries: the text that Spark runs and, where dialects differ, the oracle's."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Case:
    tables: tuple[str, ...]
    text: str
    oracle: str
    params: dict | None = None


CASES: dict[str, Case] = {}


def case(key: str, tables: str, text: str, oracle: str | None = None, **params) -> None:
    CASES[key] = Case(tuple(tables.split()), text, oracle or text, params or None)


case("revenue_by_nation", "lineitem orders customer nation",
     "SELECT n_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= :least GROUP BY n_name HAVING COUNT(*) > 5 ORDER BY revenue DESC, n_name LIMIT 10",
     "SELECT n_name, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 5 GROUP BY n_name HAVING COUNT(*) > 5 ORDER BY revenue DESC, n_name LIMIT 10", least=5)
case("filter_three_valued", "orders",
     "SELECT COUNT(*) AS n, COUNT(CASE WHEN s = 'O' THEN 1 END) AS t, COUNT(CASE WHEN NOT (s = 'O') THEN 1 END) AS f, COUNT(CASE WHEN (s = 'O') IS NULL THEN 1 END) AS u, COUNT(CASE WHEN s = 'O' OR o_totalprice > 0 THEN 1 END) AS t_or, COUNT(CASE WHEN s = 'O' AND o_totalprice > 1000 THEN 1 END) AS t_and, COUNT(CASE WHEN s IS NOT NULL THEN 1 END) AS known FROM (SELECT NULLIF(o_orderstatus, 'F') AS s, o_totalprice FROM orders) x")
case("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
case("not_in_subquery_null", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)")
case("in_list", "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 15) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
case("exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
case("not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
case("between_not_between", "lineitem", "SELECT COUNT(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 END) AS inside, COUNT(CASE WHEN l_quantity NOT BETWEEN 10 AND 20 THEN 1 END) AS outside FROM lineitem")
case("inner_join", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
case("left_join_pad", "customer orders", "SELECT c_custkey, COUNT(o_orderkey) AS n, SUM(CAST(o_totalprice AS DOUBLE)) IS NULL AS none FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000 GROUP BY c_custkey")
case("cross_join", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
case("theta_join", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
case("theta_left_join", "nation region", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey > r_regionkey AND r_regionkey > 2")
case("compound_on", "lineitem", "SELECT a.l_orderkey, a.l_linenumber, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
case("multi_join", "region nation supplier", "SELECT r_name, n_name, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
case("self_join", "nation", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
case("join_limit", "orders customer", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey LIMIT 100) x")
case("right_join_ext", "supplier customer", "SELECT c_custkey, s_suppkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey")
case("full_join_ext", "supplier nation", "SELECT n_nationkey, s_suppkey FROM supplier FULL JOIN nation ON s_suppkey = n_nationkey + 20")
case("group_agg", "events", "SELECT event_type, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, ROUND(SUM(value), 2) AS total, ROUND(AVG(value), 6) AS mean FROM events GROUP BY event_type")
case("global_agg_empty", "events", "SELECT COUNT(*) AS n, MIN(value) AS low, SUM(value) AS total, AVG(value) AS mean FROM events WHERE event_id < 0")
case("distinct_agg", "orders", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, CAST(SUM(DISTINCT o_custkey) AS DOUBLE) AS s FROM orders GROUP BY o_orderstatus")
case("having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000")
case("group_by_expr", "lineitem", "SELECT l_orderkey % 7 AS k, SUM(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 2 AS twice FROM lineitem GROUP BY l_orderkey % 7",
     "SELECT l_orderkey % 7 AS k, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 2 AS DOUBLE) AS twice FROM lineitem GROUP BY l_orderkey % 7")
CASES["group_by_expr"].text = CASES["group_by_expr"].oracle
case("group_nulls", "orders", "SELECT NULLIF(o_orderstatus, 'F') AS s, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')")
case("first_row_bare", "events", "SELECT user_id, min_by(event_type, event_id) AS first_type FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
case("order_nulls", "orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC LIMIT 50")
case("order_nulls_first", "orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 50")
case("topk", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
case("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS FIRST LIMIT 10 OFFSET 25")
case("distinct_rows", "customer", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
case("union_all_by_name", "region nation", "SELECT name, k, extra FROM (SELECT r_name AS name, r_regionkey AS k, CAST(NULL AS INT) AS extra FROM region UNION ALL SELECT n_name AS name, n_nationkey AS k, n_regionkey AS extra FROM nation) u", "SELECT r_name AS name, r_regionkey AS k FROM region UNION ALL BY NAME SELECT n_regionkey AS extra, n_nationkey AS k, n_name AS name FROM nation")
case("set_ops_ext", "customer supplier", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 3")
case("cte_multi", "orders customer", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), named AS (SELECT c_custkey, c_name FROM customer) SELECT c_name, n FROM named JOIN big ON c_custkey = o_custkey WHERE n > 10")
case("cte_recursive", "region", "WITH RECURSIVE t(n) MAX RECURSION LEVEL 1000 AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 200) SELECT n, n * n AS sq FROM t", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 200) SELECT n, n * n AS sq FROM t")
case("derived_table", "lineitem", "SELECT flag, n FROM (SELECT l_returnflag AS flag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag) s WHERE n > 10")
case("named_params", "part", "SELECT p_partkey, p_name FROM static.part WHERE p_size > :low AND p_brand = :brand AND p_name <> ':low'", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_brand = 'Brand#3' AND p_name <> ':low'", low=10, brand="Brand#3")
case("stream_bounded", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 30 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey NULLS FIRST LIMIT 30 OFFSET 5")
case("fn_null", "orders", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS s, NULLIF(o_custkey, 1) AS c FROM orders")
case("fn_case", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS searched, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS simple FROM orders")
case("window_ext", "orders", "SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS nth FROM orders")
