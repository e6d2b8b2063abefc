"""Scan, projection and predicates: one pass over the file, with column pruning and pushed filters."""

from pyspark.sql import functions as F

from tarnwater.session import table


def scan_project(s, d):
    return table(s, d, "customer").select("c_custkey", F.upper("c_name").alias("name"), F.round(F.col("c_acctbal") * 2, 2).alias("twice"))


def filter_compare(s, d):
    return table(s, d, "part").where("p_size <> 7 AND p_size <= 20 AND p_retailprice > 950").select("p_partkey", "p_size")


def filter_between(s, d):
    return table(s, d, "lineitem").where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


def filter_in(s, d):
    return table(s, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


def filter_like(s, d):
    return table(s, d, "part").where(F.col("p_name").like("%ring%") | F.col("p_type").like("PRO%") | F.col("p_type").like("%MY")).select("p_partkey", "p_name", "p_type")


def filter_not_like(s, d):
    return table(s, d, "part").where(~F.col("p_type").like("MED%")).select("p_partkey", "p_type")


def filter_or_of_ands(s, d):
    c = F.col
    one = (c("l_returnflag") == "R") & (c("l_quantity") < 5)
    two = (c("l_returnflag") == "A") & (c("l_quantity") > 48)
    return table(s, d, "lineitem").where(one | two).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


def filter_col_vs_col(s, d):
    return table(s, d, "lineitem").where(F.col("l_tax") > F.col("l_discount")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def events_select_all(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value").orderBy("event_id")


def events_filter_pushdown(s, d):
    return table(s, d, "events").where("event_type = 'click'").select("event_id", "event_type", "value").orderBy("event_id")


_ALL = (scan_project, filter_compare, filter_between, filter_in, filter_like, filter_not_like, filter_or_of_ands, filter_col_vs_col, events_select_all, events_filter_pushdown)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "scan_project": "SELECT c_custkey, upper(c_name) AS name, round(c_acctbal * 2, 2) AS twice FROM customer",
    "filter_compare": "SELECT p_partkey, p_size FROM part WHERE p_size <> 7 AND p_size <= 20 AND p_retailprice > 950",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_in": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "filter_like": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE 'PRO%' OR p_type LIKE '%MY'",
    "filter_not_like": "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'MED%'",
    "filter_or_of_ands": "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity < 5) OR (l_returnflag = 'A' AND l_quantity > 48)",
    "filter_col_vs_col": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_tax > l_discount GROUP BY l_returnflag",
    "events_select_all": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id",
    "events_filter_pushdown": "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' ORDER BY event_id",
}
