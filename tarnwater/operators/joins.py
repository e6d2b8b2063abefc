"""Joins.

Catalyst takes the strategy from sizes: nothing is broadcast here by hand, so a
side that outgrows ``spark.sql.autoBroadcastJoinThreshold`` is shuffled instead,
and adaptive execution splits skewed partitions.  ``join_broadcast_dim`` names
two tables of fixed size (25 nations, 5 regions).
"""

from pyspark.sql import functions as F

from tarnwater.session import run_sql, table


def join_inner_on(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_broadcast_dim(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return table(s, d, "supplier").join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


def join_left_compound_on(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 400000), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def join_right(s, d):
    o, c = table(s, d, "orders").where("o_totalprice > 450000"), table(s, d, "customer")
    return o.join(c, c.c_custkey == o.o_custkey, "right").select("c_custkey", "o_orderkey")


def join_full(s, d):
    a = table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("a"))
    b = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full")


def join_cross(s, d):
    return table(s, d, "region").select("r_name").crossJoin(table(s, d, "nation").select("n_name"))


def join_using(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name").join(o, "k")


def join_self_alias(s, d):
    a, b = table(s, d, "nation").alias("a"), table(s, d, "nation").alias("b")
    same = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, same).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two"))


def join_two_key(s, d):
    pairs = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("available"))
    lines = table(s, d, "lineitem").where("l_quantity > 49").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return lines.join(pairs, ["l_partkey", "l_suppkey"]).groupBy("available").agg(F.count("*").alias("n"))


_SQL = {
    "join_comma_multiway": "SELECT n_name, count(*) AS n FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "join_natural": "SELECT n_nationkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r",
    "join_theta": "SELECT r_name, count(*) AS n FROM region, nation WHERE r_regionkey < n_regionkey GROUP BY r_name",
    "join_or_of_ands": "SELECT count(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20)",
    "semi_exists": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "anti_not_exists": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "exists_with_inequality": "SELECT count(*) AS n FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)",
    "semi_in": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "semi_in_group_having": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)",
    "semi_in_nested": "SELECT count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'))",
    "anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "scalar_uncorrelated_where": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)",
    "scalar_uncorrelated_having": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 20 * avg(o_totalprice) FROM orders)",
    "scalar_correlated_min": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity = (SELECT min(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)",
    "scalar_correlated_avg": "SELECT count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)",
    "scalar_correlated_sum_two_col": "SELECT count(*) AS n FROM lineitem l WHERE l_extendedprice > (SELECT 0.5 * sum(x.l_extendedprice) FROM lineitem x WHERE x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey)",
    "derived_table": "SELECT segment, round(avg(total), 4) AS mean FROM (SELECT c_mktsegment AS segment, o_totalprice AS total FROM customer JOIN orders ON c_custkey = o_custkey) t GROUP BY segment",
    "derived_column_list": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS t (k, c_count) GROUP BY c_count",
    "cte_reused": "WITH r AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT k, round(q, 2) AS q FROM r WHERE q = (SELECT max(q) FROM r)",
    "union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "fn_extract_year": "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1",
    "fn_substring_from_for": "SELECT substring(c_mktsegment FROM 1 FOR 2) AS code, count(*) AS n FROM customer GROUP BY 1",
    "fn_case_nullif": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, nullif(o_orderstatus, 'O') AS closed FROM orders",
    "fn_cast_date": "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= CAST('1996-01-01' AS date) AND l_shipdate < date '1997-01-01'",
    "fn_concat_mod_abs": "SELECT c_custkey, c_name || '-' || c_mktsegment AS label, c_custkey % 7 AS m, abs(c_acctbal) AS a FROM customer",
    "order_multi_key": "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey",
    "limit_ordered": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "limit_unordered": "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, min(o_orderkey) >= 1 AND max(o_orderkey) < 1000 AS inside FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 1000 LIMIT 3) t",
    "top_k_by_agg_alias": "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_suppkey ORDER BY revenue DESC NULLS LAST, l_suppkey LIMIT 10",
    "top_k_string_keys": "SELECT c_name, c_custkey FROM customer ORDER BY c_name DESC NULLS LAST, c_custkey LIMIT 10",
    "order_without_limit": "SELECT event_id, value FROM events ORDER BY value, event_id",
    "events_top_k": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 3",
    "window_rank": "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS place FROM customer",
    "window_running_sum": "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events",
}

_ALL = (join_inner_on, join_broadcast_dim, join_left_compound_on, join_right, join_full, join_cross, join_using, join_self_alias, join_two_key)
QUERIES = {f.__name__: f for f in _ALL} | {name: (lambda s, d, q=sql: run_sql(s, d, q)) for name, sql in _SQL.items()}
ORACLES = _SQL | {
    "join_inner_on": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_broadcast_dim": "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_left_compound_on": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000) RIGHT JOIN customer ON c_custkey = o_custkey",
    "join_full": "SELECT a, b FROM (SELECT c_custkey AS a FROM customer WHERE c_custkey % 3 = 0) FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_custkey % 2 = 0) ON a = b",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT k, c_name, o_orderkey FROM (SELECT c_custkey AS k, c_name FROM customer) JOIN (SELECT o_custkey AS k, o_orderkey FROM orders) USING (k)",
    "join_self_alias": "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_two_key": "SELECT available, count(*) AS n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS available FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey) WHERE l_quantity > 49 GROUP BY available",
}
