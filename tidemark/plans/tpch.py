"""The 22 decision-support queries on the tables at hand, in whole numbers.

The tables have no part-supplier pairs and no commit or receipt dates: pairs come from what was sold
(``offers``), lateness is (order key + line number) mod 3 = 0, and a customer's country is its nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import flag, idiv
from tidemark.operators import joins as J
from tidemark.plans.base import Group, goods, items, nations, offers, people, purchases, raw, regions, vendors
from tidemark.sources.tables import Tables

G = Group()
c = F.col


def date(text: str):
    return F.lit(text).cast("timestamp_ntz")


def net():
    """Price after discount, in ten-thousandths."""
    return c("price") * (100 - c("disc"))


def late():
    return (c("l_orderkey") + c("l_linenumber")) % 3 == 0


def vendor_nations(t: Tables) -> DataFrame:
    return vendors(t).join(nations(t), c("s_nationkey") == c("n_nationkey"))


@G.add("""SELECT l_returnflag, l_linestatus, CAST(sum(qty) AS BIGINT) AS sum_qty, CAST(sum(price) AS BIGINT) AS sum_price, CAST(sum(price * (100 - disc)) AS BIGINT) AS sum_net, CAST(sum(price * (100 - disc) * (100 + tax)) AS BIGINT) AS sum_charge,
CAST(sum(qty) // count(*) AS BIGINT) AS avg_qty, CAST(sum(price) // count(*) AS BIGINT) AS avg_price, CAST(sum(disc) // count(*) AS BIGINT) AS avg_disc, count(*) AS n FROM items WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2""")
def tpch_q1(t: Tables) -> DataFrame:
    rows = items(t).filter(c("l_shipdate") <= date("1998-09-02"))
    n = F.count(F.lit(1))
    sums = [F.sum("qty").alias("sum_qty"), F.sum("price").alias("sum_price"), F.sum(net()).alias("sum_net"), F.sum(net() * (100 + c("tax"))).alias("sum_charge")]
    means = [idiv(F.sum(x), n).alias(f"avg_{x}") for x in ("qty", "price", "disc")]
    return rows.groupBy("l_returnflag", "l_linestatus").agg(*sums, *means, n.alias("n")).orderBy("l_returnflag", "l_linestatus")


@G.add("""WITH o AS (SELECT offers.*, s_name, n_name, balance FROM offers JOIN vendors ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey JOIN regions ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
m AS (SELECT *, min(cost) OVER (PARTITION BY l_partkey) AS least FROM o JOIN goods ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND p_size <= 15)
SELECT balance, s_name, n_name, p_partkey, p_brand, cost FROM m WHERE cost = least ORDER BY balance DESC, n_name, s_name, p_partkey LIMIT 100""")
def tpch_q2(t: Tables) -> DataFrame:
    there = vendor_nations(t).join(regions(t).filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    part = goods(t).filter("p_type = 'PROMO' and p_size <= 15")
    rows = offers(t).join(part, c("l_partkey") == c("p_partkey")).join(there, c("l_suppkey") == c("s_suppkey"))
    rows = rows.withColumn("least", F.min("cost").over(Window.partitionBy("l_partkey"))).filter("cost = least")
    return rows.select("balance", "s_name", "n_name", "p_partkey", "p_brand", "cost").orderBy(c("balance").desc(), "n_name", "s_name", "p_partkey").limit(100)


@G.add("""SELECT l_orderkey, CAST(sum(price * (100 - disc)) AS BIGINT) AS revenue, o_orderdate FROM people JOIN purchases ON c_custkey = o_custkey JOIN items ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(t: Tables) -> DataFrame:
    who = people(t).filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    what = purchases(t).filter(c("o_orderdate") < date("1998-03-15")).select("o_custkey", c("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = items(t).filter(c("l_shipdate") > date("1998-03-15")).join(J.semi_join(what, who, ["o_custkey"]), "l_orderkey")
    return rows.groupBy("l_orderkey", "o_orderdate").agg(F.sum(net()).alias("revenue")).orderBy(c("revenue").desc(), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@G.add("""SELECT o_orderpriority, count(*) AS n FROM purchases WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'
AND EXISTS (SELECT 1 FROM items WHERE l_orderkey = o_orderkey AND (l_orderkey + l_linenumber) % 3 = 0) GROUP BY ALL ORDER BY 1""")
def tpch_q4(t: Tables) -> DataFrame:
    rows = purchases(t).filter((c("o_orderdate") >= date("1997-01-01")) & (c("o_orderdate") < date("1997-04-01")))
    slow = items(t).filter(late()).select(c("l_orderkey").alias("o_orderkey"))
    return J.semi_join(rows, slow, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority")


@G.add("""SELECT n_name, CAST(sum(price * (100 - disc)) AS BIGINT) AS revenue FROM people JOIN purchases ON c_custkey = o_custkey JOIN items ON l_orderkey = o_orderkey JOIN vendors ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
JOIN nations ON s_nationkey = n_nationkey JOIN regions ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL ORDER BY revenue DESC, n_name""")
def tpch_q5(t: Tables) -> DataFrame:
    there = vendor_nations(t).join(regions(t).filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    rows = purchases(t).filter((c("o_orderdate") >= date("1996-01-01")) & (c("o_orderdate") < date("1998-01-01"))).join(people(t), c("o_custkey") == c("c_custkey"))
    rows = items(t).join(rows, c("l_orderkey") == c("o_orderkey")).join(there, (c("l_suppkey") == c("s_suppkey")) & (c("s_nationkey") == c("c_nationkey")))
    return rows.groupBy("n_name").agg(F.sum(net()).alias("revenue")).orderBy(c("revenue").desc(), "n_name")


@G.add("SELECT CAST(sum(price * disc) AS BIGINT) AS revenue FROM items WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND disc BETWEEN 5 AND 7 AND qty < 24")
def tpch_q6(t: Tables) -> DataFrame:
    when = (c("l_shipdate") >= date("1997-01-01")) & (c("l_shipdate") < date("1998-01-01"))
    return items(t, raw("l_discount", 5, 7, 100) & raw("l_quantity", high=23)).filter(when & c("disc").between(5, 7) & (c("qty") < 24)).agg(F.sum(c("price") * c("disc")).alias("revenue"))


@G.add("""SELECT a.n_name AS seller, b.n_name AS buyer, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(sum(price * (100 - disc)) AS BIGINT) AS revenue FROM items JOIN purchases ON l_orderkey = o_orderkey JOIN people ON o_custkey = c_custkey JOIN vendors ON l_suppkey = s_suppkey
JOIN nations a ON s_nationkey = a.n_nationkey JOIN nations b ON c_nationkey = b.n_nationkey WHERE (a.n_name, b.n_name) IN (('NATION_3', 'NATION_9'), ('NATION_9', 'NATION_3')) GROUP BY ALL ORDER BY 1, 2, 3""")
def tpch_q7(t: Tables) -> DataFrame:
    two = nations(t).filter(c("n_name").isin("NATION_3", "NATION_9"))
    seller = vendors(t).join(two, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("seller"))
    buyer = people(t).join(two, c("c_nationkey") == c("n_nationkey")).select("c_custkey", c("n_name").alias("buyer"))
    rows = items(t).join(seller, c("l_suppkey") == c("s_suppkey")).join(purchases(t), c("l_orderkey") == c("o_orderkey")).join(buyer, c("o_custkey") == c("c_custkey"))
    rows = rows.filter("seller <> buyer").withColumn("y", F.year("l_shipdate").cast("long"))
    return rows.groupBy("seller", "buyer", "y").agg(F.sum(net()).alias("revenue")).orderBy("seller", "buyer", "y")


@G.add("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CASE WHEN b.n_name = 'NATION_3' THEN price * (100 - disc) ELSE 0 END) * 100 // sum(price * (100 - disc)) AS BIGINT) AS share
FROM items JOIN goods ON l_partkey = p_partkey JOIN purchases ON l_orderkey = o_orderkey JOIN people ON o_custkey = c_custkey JOIN nations a ON c_nationkey = a.n_nationkey JOIN regions ON a.n_regionkey = r_regionkey JOIN vendors ON l_suppkey = s_suppkey JOIN nations b ON s_nationkey = b.n_nationkey
WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' GROUP BY ALL ORDER BY y""")
def tpch_q8(t: Tables) -> DataFrame:
    there = people(t).join(nations(t), c("c_nationkey") == c("n_nationkey")).join(regions(t).filter("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey")).select("c_custkey")
    seller = vendor_nations(t).select("s_suppkey", "n_name")
    rows = items(t).join(goods(t).filter("p_type = 'ECONOMY'"), c("l_partkey") == c("p_partkey")).join(purchases(t), c("l_orderkey") == c("o_orderkey"))
    rows = rows.join(there, c("o_custkey") == c("c_custkey"), "left_semi").join(seller, c("l_suppkey") == c("s_suppkey"))
    own = F.sum(net() * flag(c("n_name") == "NATION_3")) * 100
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(idiv(own, F.sum(net())).alias("share")).orderBy("y")


@G.add("""SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(price * (100 - disc) - cost * qty) AS BIGINT) AS profit FROM items JOIN goods ON l_partkey = p_partkey JOIN offers USING (l_partkey, l_suppkey) JOIN purchases ON l_orderkey = o_orderkey
JOIN vendors ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey WHERE p_name LIKE 'small%' GROUP BY ALL ORDER BY n_name, y DESC""")
def tpch_q9(t: Tables) -> DataFrame:
    part = goods(t).filter(c("p_name").like("small%"))
    rows = items(t).join(part, c("l_partkey") == c("p_partkey")).join(offers(t).drop("available"), ["l_partkey", "l_suppkey"])
    rows = rows.join(purchases(t), c("l_orderkey") == c("o_orderkey")).join(vendor_nations(t), c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(net() - c("cost") * c("qty")).alias("profit")).orderBy("n_name", c("y").desc())


@G.add("""SELECT c_custkey, c_name, balance, n_name, CAST(sum(price * (100 - disc)) AS BIGINT) AS revenue FROM people JOIN purchases ON c_custkey = o_custkey JOIN items ON l_orderkey = o_orderkey JOIN nations ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey""")
def tpch_q10(t: Tables) -> DataFrame:
    rows = purchases(t).filter((c("o_orderdate") >= date("1997-01-01")) & (c("o_orderdate") < date("1997-07-01")))
    rows = items(t).filter("l_returnflag = 'R'").join(rows, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(F.sum(net()).alias("revenue"))
    rows = people(t).join(rows, c("c_custkey") == c("o_custkey")).join(nations(t), c("c_nationkey") == c("n_nationkey"))
    return rows.select("c_custkey", "c_name", "balance", "n_name", "revenue").orderBy(c("revenue").desc(), "c_custkey")


@G.add("""WITH v AS (SELECT l_partkey, CAST(sum(cost * available) AS BIGINT) AS value FROM offers JOIN vendors ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY ALL)
SELECT l_partkey, value FROM v WHERE value > (SELECT sum(value) // 1000 FROM v) ORDER BY value DESC, l_partkey""")
def tpch_q11(t: Tables) -> DataFrame:
    rows = offers(t).join(vendor_nations(t).filter("n_name = 'NATION_3'"), c("l_suppkey") == c("s_suppkey"))
    value = rows.groupBy("l_partkey").agg(F.sum(c("cost") * c("available")).alias("value"))
    least = value.agg(idiv(F.sum("value"), 1000).alias("least"))
    return J.inner_join(least, value, [], ["least"]).filter("value > least").select("l_partkey", "value").orderBy(c("value").desc(), "l_partkey")


@G.add("""SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low
FROM purchases JOIN items ON o_orderkey = l_orderkey WHERE (l_orderkey + l_linenumber) % 3 = 0 AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL ORDER BY 1""")
def tpch_q12(t: Tables) -> DataFrame:
    rows = items(t).filter(late() & (c("l_shipdate") >= date("1997-01-01")) & (c("l_shipdate") < date("1998-01-01"))).join(purchases(t), c("l_orderkey") == c("o_orderkey"))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return rows.groupBy("l_linestatus").agg(F.sum(flag(high)).alias("high"), F.sum(flag(~high)).alias("low")).orderBy("l_linestatus")


@G.add("""SELECT n_orders, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM people LEFT JOIN purchases ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY ALL) GROUP BY ALL ORDER BY n DESC, n_orders DESC""")
def tpch_q13(t: Tables) -> DataFrame:
    own = purchases(t).filter("o_orderpriority = '1-URGENT'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    rows = J.right_outer_join(own, people(t), ["c_custkey"], ["n_orders"])
    return rows.groupBy("n_orders").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), c("n_orders").desc())


@G.add("""SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN price * (100 - disc) ELSE 0 END) * 100 // sum(price * (100 - disc)) AS BIGINT) AS promo FROM items JOIN goods ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""")
def tpch_q14(t: Tables) -> DataFrame:
    rows = items(t).filter((c("l_shipdate") >= date("1997-09-01")) & (c("l_shipdate") < date("1997-10-01"))).join(goods(t), c("l_partkey") == c("p_partkey"))
    return rows.agg(idiv(F.sum(net() * flag(c("p_type") == "PROMO")) * 100, F.sum(net())).alias("promo"))


@G.add("""WITH r AS (SELECT l_suppkey, CAST(sum(price * (100 - disc)) AS BIGINT) AS revenue FROM items WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY ALL)
SELECT s_suppkey, s_name, revenue FROM vendors JOIN r ON s_suppkey = l_suppkey WHERE revenue = (SELECT max(revenue) FROM r) ORDER BY s_suppkey""")
def tpch_q15(t: Tables) -> DataFrame:
    rows = items(t).filter((c("l_shipdate") >= date("1997-01-01")) & (c("l_shipdate") < date("1997-04-01"))).groupBy(c("l_suppkey").alias("s_suppkey")).agg(F.sum(net()).alias("revenue"))
    best = J.inner_join(rows.agg(F.max("revenue").alias("most")), rows, [], ["most"]).filter("revenue = most")
    return vendors(t).join(best, "s_suppkey").select("s_suppkey", "s_name", "revenue").orderBy("s_suppkey")


@G.add("""SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS n FROM offers JOIN goods ON l_partkey = p_partkey WHERE p_brand <> 'Brand#5' AND p_type <> 'PROMO' AND p_size IN (1, 5, 9, 14, 19, 23, 36, 45)
AND l_suppkey NOT IN (SELECT s_suppkey FROM vendors WHERE balance < 0) GROUP BY ALL ORDER BY n DESC, p_brand, p_type, p_size""")
def tpch_q16(t: Tables) -> DataFrame:
    part = goods(t).filter((c("p_brand") != "Brand#5") & (c("p_type") != "PROMO") & c("p_size").isin(1, 5, 9, 14, 19, 23, 36, 45))
    bad = vendors(t).filter("balance < 0").select(c("s_suppkey").alias("l_suppkey"))
    rows = J.anti_join(offers(t), bad, ["l_suppkey"]).join(part, c("l_partkey") == c("p_partkey"))
    return rows.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("n")).orderBy(c("n").desc(), "p_brand", "p_type", "p_size")


@G.add("""SELECT CAST(coalesce(sum(price), 0) // 7 AS BIGINT) AS yearly FROM items i JOIN goods ON l_partkey = p_partkey WHERE p_brand = 'Brand#10' AND p_size <= 10 AND qty < (SELECT sum(qty) * 2 // 5 // count(*) FROM items j WHERE j.l_partkey = i.l_partkey)""")
def tpch_q17(t: Tables) -> DataFrame:
    part = goods(t).filter("p_brand = 'Brand#10' and p_size <= 10").select(c("p_partkey").alias("l_partkey"))
    rows = J.semi_join(items(t), part, ["l_partkey"])
    mean = rows.groupBy("l_partkey").agg(idiv(idiv(F.sum("qty") * 2, 5), F.count(F.lit(1))).alias("few"))
    return rows.join(mean, "l_partkey").filter("qty < few").agg(idiv(F.coalesce(F.sum("price"), F.lit(0)), 7).alias("yearly"))


@G.add("""SELECT c_name, c_custkey, o_orderkey, o_orderdate, total, CAST(sum(qty) AS BIGINT) AS quantity FROM people JOIN purchases ON c_custkey = o_custkey JOIN items ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM items GROUP BY 1 HAVING sum(qty) > 300) GROUP BY ALL ORDER BY total DESC, o_orderkey""")
def tpch_q18(t: Tables) -> DataFrame:
    big = items(t).groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("qty").alias("quantity")).filter("quantity > 300")
    rows = purchases(t).join(big, "o_orderkey").join(people(t), c("o_custkey") == c("c_custkey"))
    return rows.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "total", "quantity").orderBy(c("total").desc(), "o_orderkey")


@G.add("""SELECT CAST(coalesce(sum(price * (100 - disc)), 0) AS BIGINT) AS revenue FROM items JOIN goods ON l_partkey = p_partkey WHERE
(p_brand = 'Brand#5' AND p_partkey & 3 = 0 AND qty BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#12' AND p_partkey & 3 = 1 AND qty BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#24' AND p_partkey & 3 = 2 AND qty BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35)""")
def tpch_q19(t: Tables) -> DataFrame:
    low = c("p_partkey").bitwiseAND(F.lit(3).cast("long"))
    part = lambda brand, bits, size: (c("p_brand") == brand) & (low == bits) & c("p_size").between(1, size)
    a, b, d = part("Brand#5", 0, 15), part("Brand#12", 1, 25), part("Brand#24", 2, 35)
    rows = items(t, raw("l_quantity", 1, 30)).join(goods(t).filter(a | b | d), c("l_partkey") == c("p_partkey"))
    rows = rows.filter((a & c("qty").between(1, 11)) | (b & c("qty").between(10, 20)) | (d & c("qty").between(20, 30)))
    return rows.agg(F.coalesce(F.sum(net()), F.lit(0)).alias("revenue"))


@G.add("""SELECT s_suppkey, s_name FROM vendors JOIN nations ON s_nationkey = n_nationkey WHERE n_regionkey <= 1 AND s_suppkey IN (SELECT o.l_suppkey FROM offers o JOIN goods ON o.l_partkey = p_partkey
JOIN (SELECT l_partkey, l_suppkey, sum(qty) AS sold FROM items WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL) i ON o.l_partkey = i.l_partkey AND o.l_suppkey = i.l_suppkey WHERE p_name LIKE 'small%' AND 2 * available > 3 * sold) ORDER BY s_suppkey""")
def tpch_q20(t: Tables) -> DataFrame:
    sold = items(t).filter((c("l_shipdate") >= date("1997-01-01")) & (c("l_shipdate") < date("1998-01-01"))).groupBy("l_partkey", "l_suppkey").agg(F.sum("qty").alias("sold"))
    part = goods(t).filter(c("p_name").like("small%")).select(c("p_partkey").alias("l_partkey"))
    much = J.semi_join(offers(t), part, ["l_partkey"]).join(sold, ["l_partkey", "l_suppkey"]).filter("2 * available > 3 * sold").select(c("l_suppkey").alias("s_suppkey"))
    return J.semi_join(vendor_nations(t).filter("n_regionkey <= 1"), much, ["s_suppkey"]).select("s_suppkey", "s_name").orderBy("s_suppkey")


@G.add("""WITH s AS (SELECT l_orderkey, l_suppkey, max(CAST((l_orderkey + l_linenumber) % 3 = 0 AS INT)) AS slow FROM items GROUP BY ALL), o AS (SELECT l_orderkey, count(*) AS sellers, sum(slow) AS slows FROM s GROUP BY ALL)
SELECT s_name, count(*) AS n FROM s JOIN o USING (l_orderkey) JOIN purchases ON l_orderkey = o_orderkey JOIN vendors ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey
WHERE slow = 1 AND sellers > 1 AND slows = 1 AND o_orderstatus = 'F' AND n_name = 'NATION_3' GROUP BY ALL ORDER BY n DESC, s_name LIMIT 100""")
def tpch_q21(t: Tables) -> DataFrame:
    sellers = items(t).groupBy("l_orderkey", "l_suppkey").agg(F.max(flag(late())).alias("slow"))
    alone = sellers.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("sellers"), F.sum("slow").alias("slows")).filter("sellers > 1 and slows = 1")
    done = purchases(t).filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    rows = J.semi_join(sellers.filter("slow = 1").join(alone, "l_orderkey"), done, ["l_orderkey"])
    rows = rows.join(vendor_nations(t).filter("n_name = 'NATION_3'"), c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy("s_name").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "s_name").limit(100)


@G.add("""WITH r AS (SELECT * FROM people WHERE c_nationkey IN (1, 3, 5, 7, 11, 13, 17)), m AS (SELECT sum(balance) // count(*) AS mean FROM r WHERE balance > 0)
SELECT c_nationkey, count(*) AS n, CAST(sum(balance) AS BIGINT) AS total FROM r, m WHERE balance > mean AND c_custkey NOT IN (SELECT o_custkey FROM purchases WHERE o_orderpriority = '1-URGENT') GROUP BY ALL ORDER BY 1""")
def tpch_q22(t: Tables) -> DataFrame:
    rows = people(t).filter(c("c_nationkey").isin(1, 3, 5, 7, 11, 13, 17))
    mean = rows.filter("balance > 0").agg(idiv(F.sum("balance"), F.count(F.lit(1))).alias("mean"))
    busy = purchases(t).filter("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"))
    idle = J.anti_join(J.inner_join(mean, rows, [], ["mean"]).filter("balance > mean"), busy, ["c_custkey"])
    return idle.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total")).orderBy("c_nationkey")


QUERIES, SQL = G.queries, G.sql
