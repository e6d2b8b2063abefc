"""Aggregation: partial sums in each task, one exchange of the groups, final sums."""

from pyspark.sql import functions as F

from tarnwater.engine import default_names
from tarnwater.session import run_sql, table

DISC = "l_extendedprice * (1 - l_discount)"


def events_group_count(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


def events_partial_agg(s, d):
    return table(s, d, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def events_avg(s, d):
    return table(s, d, "events").agg(F.round(F.avg("value"), 4).alias("mean"))


def agg_count_sum_min_max(s, d):
    price = F.col("o_totalprice")
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("o_custkey").alias("m"), F.round(F.sum(price), 2).alias("total"), F.min(price).alias("least"), F.max(price).alias("most"))


def agg_avg(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("mean"))


def agg_minmax_nonnumeric(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.min("o_orderstatus").alias("low"))


def agg_count_distinct(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("l_tax"), 6).alias("tax"))


def agg_count_distinct_global(s, d):
    return table(s, d, "orders").agg(F.countDistinct("o_custkey").alias("customers"))


def agg_expression(s, d):
    return table(s, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.expr(DISC) * (1 + F.col("l_tax"))), 2).alias("charge"))


def agg_case(s, d):
    urgent = F.when(F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").like("%URGENT%"), 1).otherwise(0)
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.sum(urgent).cast("bigint").alias("urgent"), F.sum(1 - urgent).cast("bigint").alias("others"))


def agg_ratio(s, d):
    kept = F.sum(F.when(F.col("l_returnflag") == "R", F.expr(DISC)).otherwise(0.0))
    return table(s, d, "lineitem").agg(F.round(100.0 * kept / F.nullif(F.sum(F.expr(DISC)), F.lit(0.0)), 4).alias("share"))


def agg_having(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


def agg_nested_group(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), F.desc("n"))


def agg_group_by_alias(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier_no")).agg(F.round(F.sum(F.expr(DISC)), 2).alias("revenue"))


def rollup(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def agg_default_names(s, d):
    return default_names(run_sql(s, d, "SELECT o_orderstatus, count(*), sum(o_orderkey) FROM orders GROUP BY o_orderstatus"))


_ALL = (events_group_count, events_partial_agg, events_avg, agg_count_sum_min_max, agg_avg, agg_minmax_nonnumeric, agg_count_distinct, agg_count_distinct_global, agg_expression, agg_case, agg_ratio, agg_having, agg_nested_group, agg_group_by_alias, rollup, cube, agg_default_names)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "events_group_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type",
    "events_partial_agg": "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events",
    "events_avg": "SELECT round(avg(value), 4) AS mean FROM events",
    "agg_count_sum_min_max": "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS m, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus",
    "agg_avg": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL",
    "agg_minmax_nonnumeric": "SELECT o_orderpriority, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderstatus) AS low FROM orders GROUP BY o_orderpriority",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct_global": "SELECT count(DISTINCT o_custkey) AS customers FROM orders",
    "agg_expression": f"SELECT l_linestatus, round(sum({DISC} * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_linestatus",
    "agg_case": "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%URGENT%' THEN 1 ELSE 0 END)::BIGINT AS urgent, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%URGENT%' THEN 0 ELSE 1 END)::BIGINT AS others FROM orders GROUP BY o_orderstatus",
    "agg_ratio": f"SELECT round(100.0::DOUBLE * sum(CASE WHEN l_returnflag = 'R' THEN {DISC} ELSE 0 END) / nullif(sum({DISC}), 0), 4) AS share FROM lineitem",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_nested_group": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n ORDER BY customers DESC, n DESC",
    "agg_group_by_alias": f"SELECT l_suppkey AS supplier_no, round(sum({DISC}), 2) AS revenue FROM lineitem GROUP BY supplier_no",
    "agg_default_names": 'SELECT o_orderstatus, count(*) AS "count", sum(o_orderkey)::BIGINT AS "sum(o_orderkey)" FROM orders GROUP BY o_orderstatus',
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
