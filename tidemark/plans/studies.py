"""Health and finance studies, on events (a user is a patient, an event a diagnosis) and trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import flag, idiv
from tidemark.operators import joins as J
from tidemark.plans.base import Group, goods, happenings, items, nations, people, purchases, raw, vendors
from tidemark.sources.tables import Tables

G = Group()
c = F.col


@G.add("SELECT count(DISTINCT d.user_id) AS patients FROM happenings d JOIN happenings m ON d.user_id = m.user_id AND d.t <= m.t WHERE d.event_type = 'error' AND m.event_type = 'purchase'")
def aspirin(t: Tables) -> DataFrame:
    """Patients with a prescription at or after a diagnosis: the first of one and the last of the other tell."""
    times = happenings(t).groupBy("user_id").agg(F.min(F.when(c("event_type") == "error", c("t"))).alias("first"), F.max(F.when(c("event_type") == "purchase", c("t"))).alias("last"))
    return times.filter("first <= last").agg(F.count(F.lit(1)).alias("patients"))


@G.add("SELECT event_type, count(*) AS n FROM happenings WHERE user_id IN (SELECT user_id FROM happenings WHERE event_type = 'error' AND amount > 20000) GROUP BY ALL ORDER BY n DESC, event_type DESC LIMIT 10")
def comorbidity(t: Tables) -> DataFrame:
    cohort = happenings(t).filter("event_type = 'error' and amount > 20000")
    return J.semi_join(happenings(t), cohort, ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), c("event_type").desc()).limit(10)


@G.add("SELECT user_id, min(amount) AS low, max(amount) AS high FROM happenings WHERE t >= 1704067200 GROUP BY ALL HAVING max(amount) - min(amount) > 30000")
def credit_score(t: Tables) -> DataFrame:
    return happenings(t).filter("t >= 1704067200").groupBy("user_id").agg(F.min("amount").alias("low"), F.max("amount").alias("high")).filter("high - low > 30000")


@G.add("SELECT n_regionkey AS class, CAST(sum(c.balance * s.balance) AS BIGINT) AS total, count(*) AS pairs FROM people c JOIN vendors s ON c_nationkey = s_nationkey JOIN nations ON s_nationkey = n_nationkey WHERE c.balance > 0 GROUP BY ALL")
def custom_agg(t: Tables) -> DataFrame:
    """A many-to-many join of three tables, each side summed before it meets the other.

    Products are added up beyond 64 bits, as in SQL; only a total that no BIGINT holds is an error.
    """
    left = people(t).filter("balance > 0").withColumnRenamed("c_nationkey", "k")
    both = J.preaggregated_join(left, vendors(t).withColumnRenamed("s_nationkey", "k"), "k", [("balance", "a", "sum"), ("k", "m", "count")], [("balance", "b", "sum"), ("k", "n", "count")])
    rows = both.join(nations(t), c("k") == c("n_nationkey"))
    return rows.groupBy(c("n_regionkey").alias("class")).agg(F.sum(c("a").cast("decimal(19,0)") * c("b").cast("decimal(19,0)")).cast("long").alias("total"), F.sum(c("m") * c("n")).alias("pairs"))


@G.add("SELECT DISTINCT d.user_id FROM happenings d JOIN happenings m USING (user_id) WHERE d.event_type = 'error' AND m.event_type = 'signup' AND m.amount > 10000")
def distinct_patients(t: Tables) -> DataFrame:
    ill = happenings(t).filter("event_type = 'error'").select("user_id").distinct()
    return J.semi_join(ill, happenings(t).filter("event_type = 'signup' and amount > 10000"), ["user_id"])


@G.add("WITH r AS (SELECT l_suppkey, sum(price) // 100 AS revenue FROM items GROUP BY ALL) SELECT CAST(sum(revenue * revenue) * 10000 // (sum(revenue) * sum(revenue)) AS BIGINT) AS hhi FROM r")
def market_share(t: Tables) -> DataFrame:
    """Concentration: the sum of squared shares."""
    by = items(t).groupBy("l_suppkey").agg(idiv(F.sum("price"), 100).cast("decimal(19,0)").alias("r"))
    sums = by.agg(F.sum(c("r").cast("decimal(19,0)") * c("r")).cast("decimal(33,0)").alias("squares"), F.sum("r").cast("decimal(19,0)").alias("all"))
    return sums.select(F.expr("cast(cast(squares * 10000 as decimal(38,0)) div cast(all * all as decimal(38,0)) as bigint)").alias("hhi"))


@G.add("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM people GROUP BY ALL HAVING count(*) > 1")
def password_reuse(t: Tables) -> DataFrame:
    return people(t).groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@G.add("WITH n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next FROM happenings WHERE event_type = 'signup') SELECT DISTINCT user_id FROM n WHERE next - t BETWEEN 86400 AND 259200")
def recurrence(t: Tables) -> DataFrame:
    """Patients with the same diagnosis again one to three days later."""
    after = F.lead("t").over(Window.partitionBy("user_id").orderBy("t"))
    rows = happenings(t).filter("event_type = 'signup'").withColumn("wait", after - c("t"))
    return rows.filter(c("wait").between(86400, 259200)).select("user_id").distinct()


@G.add("SELECT p_size, count(*) AS n FROM goods JOIN items ON p_size = qty GROUP BY ALL")
def join_counts(t: Tables) -> DataFrame:
    left, right = goods(t).groupBy("p_size").agg(F.count(F.lit(1)).alias("a")), items(t).groupBy(c("qty").alias("p_size")).agg(F.count(F.lit(1)).alias("b"))
    return left.join(right, "p_size").select("p_size", (c("a") * c("b")).alias("n"))


# Two owners of a vertically or horizontally split table


@G.add("SELECT l_returnflag, l_linestatus, CAST(sum(qty) AS BIGINT) AS sum_qty, CAST(sum(price) AS BIGINT) AS sum_price, count(*) AS n FROM items WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def split_q1(t: Tables) -> DataFrame:
    """Both owners sum up their own rows; the sums are combined."""
    mine = c("l_orderkey") % 2 == 0
    sums = [F.sum("qty").alias("sum_qty"), F.sum("price").alias("sum_price"), F.count(F.lit(1)).alias("n")]
    rows = items(t).filter(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    parts = [rows.filter(own).groupBy("l_returnflag", "l_linestatus").agg(*sums) for own in (mine, ~mine)]
    return parts[0].union(parts[1]).groupBy("l_returnflag", "l_linestatus").agg(*[F.sum(x).alias(x) for x in ("sum_qty", "sum_price", "n")])


@G.add("SELECT o_orderstatus, CAST(sum(total) AS BIGINT) AS sum_total, count(*) AS n FROM purchases WHERE o_orderpriority <= '2-HIGH' GROUP BY ALL")
def split_q1_columns(t: Tables) -> DataFrame:
    """Each owner has some of an order's columns; they meet on the unique key."""
    left = purchases(t).filter("o_orderpriority <= '2-HIGH'").select("o_orderkey", "o_orderstatus")
    rows = J.unique_join(left, purchases(t).select("o_orderkey", "total"), ["o_orderkey"], ["o_orderstatus"])
    return rows.groupBy("o_orderstatus").agg(F.sum("total").alias("sum_total"), F.count(F.lit(1)).alias("n"))


@G.add("SELECT CAST(sum(price * disc) AS BIGINT) AS revenue FROM items WHERE disc BETWEEN 5 AND 7 AND qty < 24")
def split_q6(t: Tables) -> DataFrame:
    mine = c("l_orderkey") % 2 == 0
    rows = items(t, raw("l_discount", 5, 7, 100) & raw("l_quantity", high=23)).filter(c("disc").between(5, 7) & (c("qty") < 24))
    parts = [rows.filter(own).agg(F.sum(c("price") * c("disc")).alias("revenue")) for own in (mine, ~mine)]
    return parts[0].union(parts[1]).agg(F.sum("revenue").alias("revenue"))


@G.add("""WITH l AS (SELECT l_orderkey, l_linestatus, count(*) AS n FROM items WHERE (l_orderkey + l_linenumber) % 3 = 0 GROUP BY ALL)
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN n ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE n END) AS BIGINT) AS low FROM l JOIN purchases ON l_orderkey = o_orderkey GROUP BY ALL""")
def split_q12(t: Tables) -> DataFrame:
    """Line items are counted per order by their owner, so that the join is on unique orders."""
    own = items(t).filter((c("l_orderkey") + c("l_linenumber")) % 3 == 0).groupBy(c("l_orderkey").alias("o_orderkey"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    high = flag(c("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    rows = own.join(purchases(t).select("o_orderkey", high.alias("high")), "o_orderkey")
    return rows.groupBy("l_linestatus").agg(F.sum(c("n") * c("high")).alias("high"), F.sum(c("n") * (1 - c("high"))).alias("low"))


@G.add("SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN price * (100 - disc) ELSE 0 END) AS BIGINT) AS promo, CAST(sum(price * (100 - disc)) AS BIGINT) AS total FROM items JOIN goods ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'")
def split_q14(t: Tables) -> DataFrame:
    when = (c("l_shipdate") >= F.lit("1997-09-01").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit("1997-10-01").cast("timestamp_ntz"))
    own = items(t).filter(when).groupBy(c("l_partkey").alias("p_partkey")).agg(F.sum(c("price") * (100 - c("disc"))).alias("net"))
    rows = J.unique_join(goods(t).select("p_partkey", flag(c("p_type") == "PROMO").alias("promo")), own, ["p_partkey"], ["promo"])
    return rows.agg(F.sum(c("net") * c("promo")).alias("promo"), F.sum("net").alias("total"))


QUERIES, SQL = G.queries, G.sql
