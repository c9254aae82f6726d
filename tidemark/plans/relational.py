"""One small query for each relational operator and expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import table as R
from tidemark.plans.base import Group, goods, happenings, items, nations, offers, people, purchases, raw, vendors
from tidemark.sources.tables import Tables, read_csv, scratch, write_csv, zero_table

G = Group()


# Scans, projections, filters


@G.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_project(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@G.add("SELECT * FROM nations")
def csv_scan(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    write_csv(nations(t), path)
    return read_csv(t.spark, path, "n_nationkey long, n_name string, n_regionkey long")


@G.add("SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM range(10)")
def zero_rows(t: Tables) -> DataFrame:
    return zero_table(t.spark, ["a", "b"], 10)


@G.add("SELECT l_orderkey, l_linenumber, qty, disc FROM items WHERE qty > 30 AND disc >= 5 OR l_returnflag = 'R'")
def filter_and_or(t: Tables) -> DataFrame:
    rows = items(t, (raw("l_quantity", 31) & raw("l_discount", 5, scale=100)) | (F.col("l_returnflag") == "R"))
    return rows.filter(((F.col("qty") > 30) & (F.col("disc") >= 5)) | (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "qty", "disc")


@G.add("SELECT o_orderkey, total FROM purchases WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND total BETWEEN 5000000 AND 20000000")
def filter_between_in(t: Tables) -> DataFrame:
    return purchases(t, raw("o_totalprice", 5_000_000, 20_000_000, 100)).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("total").between(5_000_000, 20_000_000)).select("o_orderkey", "total")


@G.add("SELECT c_custkey AS id, c_nationkey, balance, CAST(0 AS BIGINT) AS marked FROM people")
def add_rename_drop(t: Tables) -> DataFrame:
    return R.Table(people(t)).add_columns(["marked"]).delete_columns(["c_name", "c_mktsegment"]).rename("c_custkey", "id").df


# Expressions


@G.add("SELECT l_orderkey, l_linenumber, price // nullif(qty, 0) AS unit, price % nullif(qty, 0) AS rest, -price AS negative, price * (100 - disc) AS net, -price // 7 AS down FROM items")
def arith_int_div(t: Tables) -> DataFrame:
    p, q = F.col("price"), F.col("qty")
    return items(t).select("l_orderkey", "l_linenumber", S.idiv(p, q).alias("unit"), S.remainder(p, q).alias("rest"), (-p).alias("negative"), (p * (100 - F.col("disc"))).alias("net"), S.idiv(-p, 7).alias("down"))


@G.add("SELECT o_orderkey, " + ", ".join(f"CAST(total {op} 10000000 AS BIGINT) AS {n}" for op, n in (("=", "eq"), ("<>", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge"))) + ", CAST(total > 10000000 AND o_orderstatus = 'F' AS BIGINT) AS both_, CAST(NOT total > 10000000 OR o_orderstatus = 'F' AS BIGINT) AS either_ FROM purchases")
def compare_ops(t: Tables) -> DataFrame:
    c, f = F.col("total"), F.col("o_orderstatus") == "F"
    k = 10_000_000
    shown = {"eq": c == k, "ne": c != k, "lt": c < k, "le": c <= k, "gt": c > k, "ge": c >= k, "both_": (c > k) & f, "either_": ~(c > k) | f}
    return purchases(t).select("o_orderkey", *[S.flag(x).alias(n) for n, x in shown.items()])


@G.add("SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS o, xor(o_orderkey, o_custkey) AS x, ~o_orderkey AS n, o_orderkey << 2 AS l, -o_orderkey >> 1 AS r, (-o_orderkey >> 3) & 2305843009213693951 AS u FROM orders")
def bitwise_shift(t: Tables) -> DataFrame:
    k, byte = F.col("o_orderkey"), F.lit(255).cast("long")
    return t.orders.select("o_orderkey", k.bitwiseAND(byte).alias("a"), k.bitwiseOR(byte).alias("o"), k.bitwiseXOR(F.col("o_custkey")).alias("x"), F.bitwise_not(k).alias("n"), F.shiftleft(k, 2).alias("l"), F.shiftright(-k, 1).alias("r"), F.shiftrightunsigned(-k, 3).alias("u"))


@G.add("SELECT o_orderkey, CAST(bit_count(o_orderkey) AS BIGINT) AS bits, CAST(bit_count(o_orderkey) % 2 AS BIGINT) AS odd, o_orderkey & 1 AS low, -(o_orderkey & 1) AS wide FROM orders")
def parity_popcount(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.bit_count(k).cast("long").alias("bits"), S.parity(k).alias("odd"), S.low_bit(k).alias("low"), S.extend_low_bit(k).alias("wide"))


@G.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -total ELSE total END AS signed FROM purchases")
def case_multiplex(t: Tables) -> DataFrame:
    return purchases(t).select("o_orderkey", S.multiplex(S.flag(F.col("o_orderstatus") == "F"), F.col("total"), -F.col("total")).alias("signed"))


@G.add("SELECT o_orderkey, CAST(total >= 5000000 AS BIGINT) + 2 * CAST(total >= 10000000 AS BIGINT) + 4 * CAST(total >= 20000000 AS BIGINT) AS code FROM purchases")
def bucket_code(t: Tables) -> DataFrame:
    return purchases(t).select("o_orderkey", S.bucket_code(F.col("total"), [5_000_000, 10_000_000, 20_000_000]).alias("code"))


@G.add("SELECT c_custkey, CAST(balance < 0 AS BIGINT) AS below, CAST(balance >= 0 AS BIGINT) AS above FROM people")
def ltz_gtez(t: Tables) -> DataFrame:
    return people(t).select("c_custkey", S.ltz(F.col("balance")).alias("below"), S.gtez(F.col("balance")).alias("above"))


@G.add("SELECT l_orderkey, l_linenumber, (CAST(round(l_quantity * 65536) AS BIGINT) * CAST(round(l_discount * 65536) AS BIGINT)) >> 16 AS product FROM lineitem")
def fixed_point_mul(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), S.fixed_mul(S.fixed(F.col("l_quantity")), S.fixed(F.col("l_discount"))).alias("product"))


@G.add("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(o_orderpriority LIKE '%HIGH' AS BIGINT) AS high FROM orders")
def year_and_like(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), S.flag(F.col("o_orderpriority").like("%HIGH")).alias("high"))


# Joins


def _urgent(t: Tables) -> DataFrame:
    return purchases(t).filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "total")


_URGENT = "u AS (SELECT o_custkey AS c_custkey, o_orderkey, total FROM purchases WHERE o_orderpriority = '1-URGENT')"


@G.add(f"WITH {_URGENT} SELECT u.*, c_nationkey FROM u JOIN people USING (c_custkey)")
def inner_join_copy(t: Tables) -> DataFrame:
    return J.inner_join(people(t), _urgent(t), ["c_custkey"], ["c_nationkey"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, c_nationkey, CAST(sum(total) AS BIGINT) AS spent, count(*) AS n, max(total) AS most FROM u JOIN people USING (c_custkey) GROUP BY ALL")
def inner_join_agg(t: Tables) -> DataFrame:
    return J.inner_join(people(t), _urgent(t), ["c_custkey"], ["c_nationkey"], [("total", "spent", "sum"), ("total", "n", "count"), ("total", "most", "max")])


@G.add("SELECT l_partkey, l_suppkey, count(*) AS n FROM items JOIN (SELECT l_partkey, l_suppkey FROM offers WHERE cost > 200000) USING (l_partkey, l_suppkey) GROUP BY ALL")
def join_composite_key(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_suppkey"]
    sold = J.dealt(items(t), keys)
    return J.inner_join(offers(t, sold).filter("cost > 200000"), sold, keys, specs=[("qty", "n", "count")])


@G.add(f"WITH {_URGENT} SELECT c_custkey, balance, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(total, 0) AS total FROM people LEFT JOIN u USING (c_custkey)")
def left_outer_zero(t: Tables) -> DataFrame:
    return J.left_outer_join(people(t), _urgent(t), ["c_custkey"], ["balance"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, o_orderkey, total, coalesce(balance, 0) AS balance FROM u LEFT JOIN (SELECT * FROM people WHERE balance > 0) USING (c_custkey)")
def right_outer_zero(t: Tables) -> DataFrame:
    return J.right_outer_join(people(t).filter("balance > 0"), _urgent(t), ["c_custkey"], ["balance"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, o_orderkey, total, coalesce(balance, 0) AS balance FROM u LEFT JOIN (SELECT * FROM people WHERE balance > 0) USING (c_custkey) UNION ALL SELECT c_custkey, 0, 0, balance FROM people WHERE balance > 0")
def full_outer_union(t: Tables) -> DataFrame:
    return J.full_outer_union(people(t).filter("balance > 0").select("c_custkey", "balance"), _urgent(t), ["c_custkey"], ["balance"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(total, 0) AS total, coalesce(balance, 0) AS balance FROM u FULL JOIN (SELECT c_custkey, balance FROM people WHERE balance > 0) USING (c_custkey)")
def full_outer_sql(t: Tables) -> DataFrame:
    return J.full_outer_join(people(t).filter("balance > 0").select("c_custkey", "balance"), _urgent(t), ["c_custkey"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, balance FROM people WHERE c_custkey IN (SELECT c_custkey FROM u)")
def semi_join(t: Tables) -> DataFrame:
    return J.semi_join(people(t).select("c_custkey", "balance"), _urgent(t), ["c_custkey"])


@G.add(f"WITH {_URGENT} SELECT c_custkey, balance FROM people WHERE c_custkey NOT IN (SELECT c_custkey FROM u)")
def anti_join(t: Tables) -> DataFrame:
    return J.anti_join(people(t).select("c_custkey", "balance"), _urgent(t), ["c_custkey"])


@G.add("SELECT a.o_orderkey, total, o_custkey FROM purchases a WHERE o_orderstatus = 'F' AND total > 5000000")
def unique_join(t: Tables) -> DataFrame:
    left = purchases(t).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return J.unique_join(left, purchases(t, raw("o_totalprice", 5_000_001, scale=100)).filter("total > 5000000").select("o_orderkey", "total"), ["o_orderkey"], ["o_custkey"])


@G.add("SELECT n.n_nationkey AS k, c_custkey, s_suppkey FROM people c JOIN nations n ON c_nationkey = n_nationkey JOIN vendors s ON s_nationkey = n_nationkey")
def cartesian_eq(t: Tables) -> DataFrame:
    left = people(t).select(F.col("c_nationkey").alias("k"), "c_custkey")
    return J.equi_join(left, vendors(t).select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k")


@G.add("SELECT a.event_id AS first_id, b.event_id AS next_id, b.t - a.t AS gap FROM happenings a JOIN happenings b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.t <= b.t AND b.t - a.t <= 86400")
def theta_join(t: Tables) -> DataFrame:
    a, b = happenings(t).filter("event_type = 'error'").alias("a"), happenings(t).filter("event_type = 'purchase'").alias("b")
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.t") <= F.col("b.t")) & (F.col("b.t") - F.col("a.t") <= 86400)
    return J.theta_join(a, b, near).select(F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("next_id"), (F.col("b.t") - F.col("a.t")).alias("gap"))


@G.add("SELECT c_custkey, balance, mean FROM people CROSS JOIN (SELECT CAST(sum(balance) AS BIGINT) // count(*) AS mean FROM people) WHERE balance > mean")
def scalar_subquery_join(t: Tables) -> DataFrame:
    mean = A.aggregate(people(t), [], [("balance", "mean", "avg")])
    return J.inner_join(mean, people(t).select("c_custkey", "balance"), [], ["mean"]).filter("balance > mean")


@G.add("SELECT k, CAST(a.n * b.n AS BIGINT) AS pairs, CAST(a.n * b.total AS BIGINT) AS amount FROM (SELECT c_nationkey AS k, count(*) AS n FROM people GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n, sum(balance) AS total FROM vendors GROUP BY 1) b USING (k)")
def preagg_many_to_many(t: Tables) -> DataFrame:
    left, right = people(t).withColumnRenamed("c_nationkey", "k"), vendors(t).withColumnRenamed("s_nationkey", "k")
    both = J.preaggregated_join(left, right, "k", [("k", "n", "count")], [("k", "m", "count"), ("balance", "total", "sum")])
    return both.select("k", (F.col("n") * F.col("m")).alias("pairs"), (F.col("n") * F.col("total")).alias("amount"))


# Aggregates


@G.add("SELECT l_returnflag, l_linestatus, CAST(sum(price) AS BIGINT) AS total, count(*) AS n, min(qty) AS least, max(qty) AS most FROM items GROUP BY ALL")
def agg_sum_count_min_max(t: Tables) -> DataFrame:
    return A.aggregate(items(t), ["l_returnflag", "l_linestatus"], [("price", "total", "sum"), ("price", "n", "count"), ("qty", "least", "min"), ("qty", "most", "max")])


@G.add("SELECT l_suppkey, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM items GROUP BY ALL")
def agg_avg_int(t: Tables) -> DataFrame:
    return A.aggregate(items(t), ["l_suppkey"], [("price", "mean", "avg")])


@G.add("SELECT o_custkey, bit_or(o_orderkey) AS bits FROM orders GROUP BY ALL")
def agg_bit_or(t: Tables) -> DataFrame:
    return A.aggregate(t.orders, ["o_custkey"], [("o_orderkey", "bits", "bit_or")])


@G.add("SELECT o_custkey, c_nationkey AS nation, count(*) AS n FROM purchases JOIN people ON o_custkey = c_custkey GROUP BY ALL")
def agg_copy_first(t: Tables) -> DataFrame:
    rows = J.inner_join(people(t).withColumnRenamed("c_custkey", "o_custkey"), purchases(t), ["o_custkey"], ["c_nationkey"])
    return A.aggregate(rows, ["o_custkey"], [("c_nationkey", "nation", "copy"), ("total", "n", "count")])


@G.add("SELECT CAST(sum(price * disc) AS BIGINT) AS total, count(*) AS n FROM items WHERE qty < 24")
def agg_global(t: Tables) -> DataFrame:
    rows = items(t, raw("l_quantity", high=23)).filter("qty < 24").withColumn("x", F.col("price") * F.col("disc"))
    return A.aggregate(rows, [], [("x", "total", "sum"), ("x", "n", "count")])


@G.add("SELECT l_orderkey, CAST(sum(qty) AS BIGINT) AS total FROM items GROUP BY ALL HAVING sum(qty) > 200")
def agg_having(t: Tables) -> DataFrame:
    return A.aggregate(items(t), ["l_orderkey"], [("qty", "total", "sum")]).filter("total > 200")


@G.add("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM items GROUP BY ALL")
def agg_count_distinct(t: Tables) -> DataFrame:
    return A.aggregate(items(t), ["l_suppkey"], [("l_partkey", "parts", "count_distinct")])


@G.add("SELECT o_custkey, bit_xor(o_orderkey) AS bits FROM orders GROUP BY ALL")
def agg_custom(t: Tables) -> DataFrame:
    import numpy as np

    return A.custom(t.orders, ["o_custkey"], "o_orderkey", "bits", np.bitwise_xor.reduce)


@G.add("SELECT CAST(label AS BIGINT) AS value FROM embeddings GROUP BY label ORDER BY count(*) DESC, label DESC LIMIT 1")
def most_common(t: Tables) -> DataFrame:
    return A.most_common(t.embeddings.select(F.col("label").cast("long").alias("label")), "label")


@G.add("SELECT event_id // 100 AS chunk, CAST(sum(amount) AS BIGINT) AS total FROM happenings GROUP BY ALL")
def chunked_sum(t: Tables) -> DataFrame:
    return A.chunked_sum(happenings(t), "event_id", "amount", 100)


_ROUNDED = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 65536) AS BIGINT))"


@G.add(f"SELECT vec_id, CAST(list_sum(list_transform({_ROUNDED}, lambda x: x * x)) AS BIGINT) AS product FROM embeddings")
def dot_product(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: S.fixed(x.cast("double")))
    return t.embeddings.select("vec_id", v.alias("v")).select("vec_id", A.dot_product(F.col("v"), F.col("v")).alias("product"))


@G.add("""SELECT coalesce(c_nationkey, -1) AS nation, coalesce(c_mktsegment, 'all') AS segment, CAST(sum(balance) // count(*) AS BIGINT) AS mean, count(*) AS n
FROM people GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), (c_mktsegment), ())""")
def wage_gap_grouping_sets(t: Tables) -> DataFrame:
    rows = people(t).cube("c_nationkey", "c_mktsegment").agg(*A.columns([("balance", "mean", "avg"), ("balance", "n", "count")]))
    return rows.select(F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "mean", "n")


@G.add("""SELECT c_mktsegment, CAST(balance >= 0 AS BIGINT) + 2 * CAST(balance >= 300000 AS BIGINT) + 4 * CAST(balance >= 600000 AS BIGINT) AS band, CAST(sum(balance) // count(*) AS BIGINT) AS mean FROM people GROUP BY ALL""")
def wage_bands(t: Tables) -> DataFrame:
    rows = people(t).withColumn("band", S.bucket_code(F.col("balance"), [0, 300_000, 600_000]))
    return A.aggregate(rows, ["c_mktsegment", "band"], [("balance", "mean", "avg")])


@G.add("""WITH m AS (SELECT o_custkey AS c_custkey, min(total) AS least FROM purchases WHERE total > 100000 GROUP BY ALL)
SELECT c_nationkey, CAST(sum(least) // count(*) AS BIGINT) AS mean, count(*) AS n FROM people JOIN m USING (c_custkey) GROUP BY ALL""")
def spend_by_nation(t: Tables) -> DataFrame:
    least = A.aggregate(purchases(t, raw("o_totalprice", 100_001, scale=100)).filter("total > 100000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], [("total", "least", "min")])
    rows = J.inner_join(people(t), least, ["c_custkey"], ["c_nationkey"])
    return A.aggregate(rows, ["c_nationkey"], [("least", "mean", "avg"), ("least", "n", "count")])


# Distinct rows and sets


@G.add("SELECT DISTINCT l_partkey, l_suppkey FROM items")
def distinct_rows(t: Tables) -> DataFrame:
    return R.distinct(items(t).select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@G.add("SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) = event_type THEN 0 ELSE 1 END::BIGINT AS changed FROM happenings")
def distinct_flag(t: Tables) -> DataFrame:
    return R.distinct_flag(happenings(t), ["event_type"], ["t", "event_id"], "changed", ["user_id"]).select("event_id", "user_id", "changed")


@G.add("SELECT c_nationkey AS k, c_custkey, 0 AS s_suppkey, CAST(0 AS BIGINT) AS side FROM people UNION ALL SELECT s_nationkey, 0, s_suppkey, 1 FROM vendors")
def concat_union_all(t: Tables) -> DataFrame:
    left = people(t).select(F.col("c_nationkey").alias("k"), "c_custkey")
    return R.concatenate(left, vendors(t).select(F.col("s_nationkey").alias("k"), "s_suppkey"), "side")


@G.add("SELECT c_nationkey AS k FROM people WHERE balance > 900000 UNION SELECT s_nationkey FROM vendors WHERE balance > 500000")
def union_distinct(t: Tables) -> DataFrame:
    return people(t).filter("balance > 900000").select(F.col("c_nationkey").alias("k")).union(vendors(t).filter("balance > 500000").select("s_nationkey")).distinct()


@G.add("SELECT c_nationkey AS k FROM people WHERE balance > 900000 INTERSECT SELECT s_nationkey FROM vendors WHERE balance > 500000")
def intersect(t: Tables) -> DataFrame:
    return people(t).filter("balance > 900000").select(F.col("c_nationkey").alias("k")).intersect(vendors(t).filter("balance > 500000").select("s_nationkey"))


@G.add("SELECT c_nationkey AS k FROM people WHERE balance > 0 EXCEPT SELECT s_nationkey FROM vendors WHERE balance > 500000", name="except")
def except_(t: Tables) -> DataFrame:
    return people(t).filter("balance > 0").select(F.col("c_nationkey").alias("k")).subtract(vendors(t).filter("balance > 500000").select("s_nationkey"))


# Order


@G.add("SELECT o_orderkey, o_custkey, total FROM purchases ORDER BY total DESC, o_orderkey")
def sort_multi_key(t: Tables) -> DataFrame:
    return R.sort(purchases(t).select("o_orderkey", "o_custkey", "total"), [("total", False), ("o_orderkey", True)])


@G.add("SELECT o_orderkey, total FROM purchases ORDER BY total DESC, o_orderkey LIMIT 10")
def top_k(t: Tables) -> DataFrame:
    return R.head(purchases(t).select("o_orderkey", "total"), [("total", False), ("o_orderkey", True)], 10)


@G.add("SELECT o_orderkey, total FROM (SELECT o_orderkey, total FROM purchases ORDER BY total, o_orderkey DESC LIMIT 10)")
def tail_k(t: Tables) -> DataFrame:
    return R.tail(purchases(t).select("o_orderkey", "total"), [("total", False), ("o_orderkey", True)], 10)


@G.add("SELECT o_orderkey, total FROM purchases ORDER BY total DESC, o_orderkey LIMIT 20 OFFSET 30")
def cut_range(t: Tables) -> DataFrame:
    return R.cut(purchases(t).select("o_orderkey", "total"), [("total", False), ("o_orderkey", True)], 30, 50)


@G.add("SELECT c_custkey, balance FROM people")
def shuffle(t: Tables) -> DataFrame:
    return R.shuffle(people(t).select("c_custkey", "balance"), 3)


@G.add("SELECT vec_id, CAST(i AS BIGINT) AS i, embedding[i + 1] AS v FROM embeddings, unnest(range(0, 64, 2)) AS u(i)")
def view_every_second(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.filter(F.col("i") % 2 == 0).select("vec_id", F.col("i").cast("long").alias("i"), "v")


@G.add("SELECT n_nationkey, CAST(i AS BIGINT) AS turn FROM nations, range(3) AS u(i)")
def view_repeated(t: Tables) -> DataFrame:
    return nations(t).select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("turn"))


# Running values


@G.add("SELECT event_id, CAST(sum(amount) OVER (ORDER BY event_id) AS BIGINT) AS upto FROM happenings")
def prefix_sum(t: Tables) -> DataFrame:
    return A.prefix_sum(happenings(t), "event_id", "amount", "upto").select("event_id", "upto")


@G.add("SELECT event_id, CAST(sum(amount) OVER (ORDER BY event_id DESC) AS BIGINT) AS onward FROM happenings")
def suffix_sum(t: Tables) -> DataFrame:
    return A.prefix_sum(happenings(t), "event_id", "amount", "onward", reverse=True).select("event_id", "onward")


@G.add("SELECT event_id, min(amount) OVER w AS least, max(amount) OVER w AS most, count(*) OVER w AS n, max(amount) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS later FROM happenings WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)")
def running_min_max(t: Tables) -> DataFrame:
    rows = A.running(happenings(t), ["user_id"], ["t", "event_id"], [("amount", "least", "min"), ("amount", "most", "max"), ("amount", "n", "count")])
    return A.running(rows, ["user_id"], ["t", "event_id"], [("amount", "later", "max")], reverse=True).select("event_id", "least", "most", "n", "later")


@G.add("SELECT event_id, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS wait FROM happenings")
def lead_shift(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return happenings(t).select("event_id", (F.lead("t").over(w) - F.col("t")).alias("wait"))


@G.add("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM happenings WHERE event_type = 'signup')
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM n a JOIN n b ON a.user_id = b.user_id AND b.r = a.r + 1 AND b.t - a.t BETWEEN 86400 AND 259200""")
def row_number_join(t: Tables) -> DataFrame:
    n = happenings(t).filter("event_type = 'signup'").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    a, b = n.alias("a"), n.alias("b")
    rows = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.r") == F.col("a.r") + 1) & (F.col("b.t") - F.col("a.t")).between(86400, 259200))
    return rows.select("a.user_id", F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("second_id"))


@G.add("SELECT n_name, price AS revenue, CAST(sum(price) OVER () AS BIGINT) AS total FROM (SELECT n_name, CAST(sum(price) AS BIGINT) AS price FROM items JOIN vendors ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey GROUP BY ALL)")
def sum_over_groups(t: Tables) -> DataFrame:
    rows = items(t).join(vendors(t), F.col("l_suppkey") == F.col("s_suppkey")).join(nations(t), F.col("s_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy("n_name").agg(F.sum("price").alias("revenue"))
    return J.inner_join(by.agg(F.sum("revenue").alias("total")), by, [], ["total"])


@G.add("SELECT p_brand, p_type, p_size, retail FROM goods WHERE (p_brand, p_size) IN (SELECT p_brand, max(p_size) FROM goods GROUP BY ALL)")
def max_back_join(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand")
    return goods(t).withColumn("most", F.max("p_size").over(w)).filter("p_size = most").select("p_brand", "p_type", "p_size", "retail")


QUERIES, SQL = G.queries, G.sql
