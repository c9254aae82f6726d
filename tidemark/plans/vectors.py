"""One small query for each operator on places, bits and plain columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import order as O
from tidemark.operators import table as R
from tidemark.plans.base import Group, happenings, nations, people, purchases
from tidemark.sources.tables import Tables, counter_table, from_columns, masked, random_table, read_column, scratch, write_column
from tidemark.sources.weights import encode_weights, read_weights

G = Group()
c = F.col


def _vector(t: Tables) -> DataFrame:
    """Events as a vector: event_id is the place."""
    return happenings(t).select(c("event_id").alias("place"), "amount")


def _size(t: Tables) -> int:
    return t.events.count()


_V = "v AS (SELECT event_id AS place, amount FROM happenings), n AS (SELECT count(*) AS n FROM events)"


def _turned(t: Tables, n: int, by: int) -> DataFrame:
    """The permutation that moves every place by ``by``, around the end."""
    return t.spark.range(n).select(c("id").alias("place"), ((c("id") + by) % n).alias("target"))


@G.add(f"WITH {_V} SELECT place, (SELECT amount FROM v b WHERE b.place = (a.place * 7) % n) AS amount FROM v a, n")
def gather(t: Tables) -> DataFrame:
    n = _size(t)
    return O.gather(_vector(t), t.spark.range(n).select(c("id").alias("place"), ((c("id") * 7) % n).alias("source")))


@G.add("SELECT event_id AS place, amount FROM happenings WHERE event_type = 'purchase'")
def extract_valid(t: Tables) -> DataFrame:
    rows = happenings(t).select(c("event_id").alias("place"), "amount", S.flag(c("event_type") == "purchase").alias("ok"))
    return O.extract_valid(rows, "ok")


@G.add(f"WITH {_V} SELECT (place + 11) % n AS place, amount FROM v, n")
def permutation_apply(t: Tables) -> DataFrame:
    return O.apply_permutation(_vector(t), _turned(t, _size(t), 11))


@G.add(f"WITH {_V} SELECT place, (place + n - 11) % n AS target FROM v, n")
def permutation_invert(t: Tables) -> DataFrame:
    return O.invert(_turned(t, _size(t), 11))


@G.add(f"WITH {_V} SELECT place, n - 1 - (place + 11) % n AS target FROM v, n")
def permutation_compose(t: Tables) -> DataFrame:
    """Moved by eleven, then read from the end."""
    n = _size(t)
    back = t.spark.range(n).select(c("id").alias("place"), (n - 1 - c("id")).alias("target"))
    return O.compose(_turned(t, n, 11), back)


@G.add(f"WITH {_V} SELECT n - 1 - place AS place, amount FROM v, n")
def vector_reverse(t: Tables) -> DataFrame:
    return O.directed_view(_vector(t), _size(t), forward=False)


@G.add(f"WITH {_V} SELECT (place - 5) // 3 AS place, amount FROM v WHERE place >= 5 AND place < 100 AND (place - 5) % 3 = 0")
def view_slice(t: Tables) -> DataFrame:
    return O.slice_view(_vector(t), 5, 100, 3)


@G.add(f"WITH {_V} SELECT (place // 5) * 2 + place % 5 AS place, amount FROM v WHERE place % 5 < 2")
def view_alternating(t: Tables) -> DataFrame:
    return O.alternating_view(_vector(t), 2, 3)


@G.add("SELECT CAST(n_nationkey * 3 + i AS BIGINT) AS place, n_name FROM nations, range(3) AS u(i)")
def view_repeated_places(t: Tables) -> DataFrame:
    return O.repeated_view(nations(t).select(c("n_nationkey").alias("place"), "n_name"), 3)


@G.add("SELECT CAST(n_nationkey + i * (SELECT count(*) FROM nations) AS BIGINT) AS place, n_name FROM nations, range(3) AS u(i)")
def view_cyclic(t: Tables) -> DataFrame:
    rows = nations(t).select(c("n_nationkey").alias("place"), "n_name")
    return O.cyclic_view(rows, rows.count(), 3)


@G.add(f"WITH {_V} SELECT place // 50 AS chunk, CAST(sum(amount * (place % 9)) AS BIGINT) AS product FROM v GROUP BY ALL")
def dot_product_chunks(t: Tables) -> DataFrame:
    return O.chunked_dot(_vector(t).withColumn("w", c("place") % 9), "amount", "w", 50)


@G.add("SELECT o_orderkey, list_transform(range(8), lambda i: (o_orderkey >> i) & 1) AS bits, o_orderkey & 3 AS low, o_orderkey & 7 AS packed FROM orders")
def bit_decomposition(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    return t.orders.select("o_orderkey", S.bits(k, 8).alias("bits"), S.mask(k, 3).alias("low"), S.pack([S.bit(k, i) for i in range(3)]).alias("packed"))


@G.add("SELECT o_orderkey, (total * 24576) >> 16 AS part, (total * 65602) >> 16 AS more FROM purchases")
def times_float(t: Tables) -> DataFrame:
    return purchases(t).select("o_orderkey", S.times_float(c("total"), 0.375).alias("part"), S.times_float(c("total"), 1.001).alias("more"))


@G.add("SELECT substring(c_name, 1, 8) AS start, count(*) AS n, CAST(sum(balance) AS BIGINT) AS total FROM people WHERE substring(c_mktsegment, 1, 2) IN ('AU', 'BU', 'MA') GROUP BY ALL")
def substring(t: Tables) -> DataFrame:
    rows = people(t).filter(F.substring("c_mktsegment", 1, 2).isin("AU", "BU", "MA"))
    return rows.groupBy(F.substring("c_name", 1, 8).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total"))


@G.add("SELECT event_id, CASE WHEN amount > 9999 THEN 2 WHEN amount > 999 THEN 1 ELSE 0 END::BIGINT AS size FROM happenings")
def column_function(t: Tables) -> DataFrame:
    """A function of the user's own on whole columns, in Arrow batches."""

    def size(amount: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted([999, 9999], amount.fillna(0).to_numpy(), "left"))

    return R.Table(happenings(t)).map_column("size", size, "long", "amount").project(["event_id", "size"]).df


@G.add("SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT), (2, 20), (3, 30)) AS v(a, b)")
def plain_columns(t: Tables) -> DataFrame:
    return from_columns(t.spark, {"a": [1, 2, 3], "b": [10, 20, 30]})


@G.add("SELECT 5 + i AS k FROM range(100) AS u(i)")
def counter(t: Tables) -> DataFrame:
    return counter_table(t.spark, "k", 100, 5)


@G.add("SELECT 1000 AS n, true AS inside")
def random_rows(t: Tables) -> DataFrame:
    """What is sure of random numbers: how many there are, and within which bounds."""
    rows = random_table(t.spark, {"a": (5, 10), "b": (-3, 3)}, 1000, 4)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(c("a").between(5, 9) & c("b").between(-3, 2)).alias("inside"))


@G.add("SELECT balance AS value FROM people")
def column_file(t: Tables) -> DataFrame:
    """A column written one value per line and read again."""
    path = scratch(t.spark, "column")
    write_column(people(t), "balance", path)
    return read_column(t.spark, path, "value")


@G.add("SELECT CASE WHEN balance > 0 THEN c_custkey ELSE 9223372036854775807 END AS c_custkey, CASE WHEN balance > 0 THEN balance ELSE 9223372036854775807 END AS balance FROM people")
def masked_rows(t: Tables) -> DataFrame:
    return masked(people(t).select("c_custkey", "balance", S.flag(c("balance") > 0).alias("ok")), "ok", 2)


@G.add("SELECT CAST(k AS BIGINT) AS k, CAST((k % 7 - 3) * 8192 AS BIGINT) AS weight FROM range(12) AS u(k)")
def weight_file(t: Tables) -> DataFrame:
    """Weights in eighths, written as 32-bit numbers in fixed point and read again, in fixed point."""
    path = scratch(t.spark, "weights")
    data = encode_weights((np.arange(12) % 7 - 3) / 8)
    hadoop = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(data))
    out.close()
    held = read_weights(t.spark, path, (3, 4))
    return t.spark.createDataFrame([(k, int(round(w * 65536))) for k, w in enumerate(held.reshape(-1))], "k long, weight long")


QUERIES, SQL = G.queries, G.sql
