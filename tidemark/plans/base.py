"""Whole-number views of the tables, as DataFrames and as SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import cents, seconds, whole
from tidemark.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Group:
    """Collects queries and their SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def take(f: Callable[[Tables], DataFrame]) -> Callable:
            key = name or f.__name__
            self.queries[key] = lambda spark, path: f(Tables(spark, path))
            if sql:
                self.sql[key] = f"WITH {VIEWS} {sql.replace('WITH ', ', ', 1)}" if sql.lstrip().startswith("WITH ") else f"WITH {VIEWS} {sql}"
            return f

        return take


def raw(column: str, low: int | None = None, high: int | None = None, scale: int = 1) -> Column:
    """What a column as stored must fulfil if ``scale`` times its value, rounded, is from ``low`` to ``high``.

    Filters on rounded values don't reach the scan; this one does, and is a little wider than they are.
    """
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= (low - 0.51) / scale)
    return out if high is None else out & (F.col(column) <= (high + 0.51) / scale)


def items(t: Tables, where: Column | None = None) -> DataFrame:
    """lineitem with money and shares in hundredths; ``where`` is a filter on the columns as stored."""
    rows = t.lineitem if where is None else t.lineitem.filter(where)
    keep = ["l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag", "l_linestatus", "l_shipdate"]
    return rows.select(*keep, whole("l_quantity").alias("qty"), cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"))


def purchases(t: Tables, where: Column | None = None) -> DataFrame:
    rows = t.orders if where is None else t.orders.filter(where)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", cents("o_totalprice").alias("total"))


def people(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment", cents("c_acctbal").alias("balance"))


def vendors(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), cents("s_acctbal").alias("balance"))


def goods(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), cents("p_retailprice").alias("retail"))


def nations(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def regions(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


def happenings(t: Tables) -> DataFrame:
    """events with time in seconds and value in hundredths."""
    return t.events.select("event_id", "user_id", "event_type", seconds("ts").alias("t"), cents("value").alias("amount"))


def offers(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    """Parts a supplier has sold: least price and quantity, one row for each pair; ``sold`` are the items if they are there already."""
    return (items(t) if sold is None else sold).groupBy("l_partkey", "l_suppkey").agg(F.min("price").alias("cost"), F.sum("qty").alias("available"))


#: The same views for DuckDB.
VIEWS = """
items AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus, l_shipdate, CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem),
purchases AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders),
people AS (SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer),
vendors AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS balance FROM supplier),
goods AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS retail FROM part),
nations AS (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation),
regions AS (SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region),
happenings AS (SELECT event_id, user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, CAST(round(value * 100) AS BIGINT) AS amount FROM events),
offers AS (SELECT l_partkey, l_suppkey, min(price) AS cost, CAST(sum(qty) AS BIGINT) AS available FROM items GROUP BY ALL)
"""
