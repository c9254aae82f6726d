"""Time windows on events, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import flag
from tidemark.plans.base import Group, happenings
from tidemark.sources.tables import Tables, scratch
from tidemark.streaming import streams, windows

G = Group()
c = F.col

_GAP = "g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 600 THEN NULL ELSE t END AS opens FROM happenings WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, max(opens) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g)"
_ABOVE = "a AS (SELECT *, amount > 10000 AS above, coalesce(lag(amount > 10000) OVER (PARTITION BY user_id ORDER BY t, amount), false) AS before FROM happenings), s AS (SELECT *, max(CASE WHEN above AND NOT before THEN t END) OVER (PARTITION BY user_id ORDER BY t, amount) AS session FROM a)"


@G.add("SELECT event_id, t // 3600 AS hour_id FROM happenings")
def tumbling_window(t: Tables) -> DataFrame:
    return windows.tumbling(happenings(t), "t", 3600, "hour_id").select("event_id", "hour_id")


@G.add(f"WITH {_GAP} SELECT event_id, session FROM s")
def gap_session(t: Tables) -> DataFrame:
    return windows.gap_session(happenings(t), ["user_id"], "t", 600, "session").select("event_id", "session")


@G.add(f"WITH {_ABOVE} SELECT event_id, session FROM s WHERE above")
def threshold_session(t: Tables) -> DataFrame:
    return windows.threshold_session(happenings(t), ["user_id"], "amount", "t", 10_000, "session").select("event_id", "session")


@G.add("SELECT user_id, t // 3600 AS hour_id, CAST(sum(amount) AS BIGINT) AS used FROM happenings GROUP BY ALL")
def energy(t: Tables) -> DataFrame:
    """Consumption per device and hour."""
    return windows.tumbling(happenings(t), "t", 3600, "hour_id").groupBy("user_id", "hour_id").agg(F.sum("amount").alias("used"))


@G.add(f"WITH {_GAP} SELECT user_id, session, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS tasks FROM s GROUP BY ALL")
def scheduling(t: Tables) -> DataFrame:
    """Selected events per machine and burst of activity."""
    rows = windows.gap_session(happenings(t), ["user_id"], "t", 600, "session")
    return rows.groupBy("user_id", "session").agg(F.sum(flag(c("event_type") == "error")).alias("tasks"))


@G.add(f"WITH {_ABOVE} SELECT user_id, session, CAST(sum(amount) AS BIGINT) AS dose, count(*) AS n FROM s WHERE above GROUP BY ALL")
def mhealth(t: Tables) -> DataFrame:
    """Doses during each stretch of high readings."""
    rows = windows.threshold_session(happenings(t), ["user_id"], "amount", "t", 10_000, "session")
    return rows.groupBy("user_id", "session").agg(F.sum("amount").alias("dose"), F.count(F.lit(1)).alias("n"))


#: Seconds after the last event at which marks stand: one for each user, so that runs end, and a last one, so that all windows close.
MARKS, LAST_MARK = 30 * 86_400, 60 * 86_400


def _events_stream(t: Tables) -> DataFrame:
    """The events as a stream, with event_type null and value 0 in the marks that follow them from a table of their own."""
    names = ["user_id", "event_type", "ts", "value"]
    events = t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    end = events.agg(F.max("ts").alias("end"))
    users = events.select("user_id").distinct().withColumn("after", F.lit(MARKS))
    last = users.agg(F.min("user_id").alias("user_id")).filter("user_id is not null").withColumn("after", F.lit(LAST_MARK))
    marks = users.union(last).crossJoin(F.broadcast(end))
    marks = marks.select("user_id", F.lit(None).cast("string").alias("event_type"), (F.col("end") + F.make_dt_interval(secs=F.col("after"))).alias("ts"), F.lit(0.0).cast(dict(t.events.dtypes)["value"]).alias("value"))
    path = scratch(t.spark, "marks")
    marks.select(*names).write.parquet(path)
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.path}/events.parque[t]").withColumn("ts", c("ts").cast("timestamp")).select(*names)
    return stream.unionByName(t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path))


@G.add("SELECT event_type, t // 86400 AS window_id, count(*) AS n FROM happenings GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    rows = streams.tumbling_stream(_events_stream(t), "ts", 86400, ["event_type"], [F.count(F.lit(1)).alias("n")])
    return streams.drain(rows, t.spark, scratch(t.spark, "stream")).filter("event_type is not null").select("event_type", "window_id", "n")


_GAP_US = "o AS (SELECT *, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 600000000 THEN NULL ELSE us END AS opens FROM o WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT *, max(opens) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g)"


@G.add(f"WITH {_GAP_US} SELECT user_id, CAST(floor(session / 1000000) AS BIGINT) AS session_id, count(*) AS n FROM s GROUP BY user_id, session")
def stream_gap(t: Tables) -> DataFrame:
    """Bursts of activity per user; the marks' own are left out."""
    made = [F.count("event_type").alias("n")]
    rows = streams.gap_stream(_events_stream(t), "ts", 600, ["user_id"], made)
    return streams.drain(rows, t.spark, scratch(t.spark, "stream")).filter("n > 0").select("user_id", "session_id", "n")


_RUN_US = "o AS (SELECT *, epoch_us(ts) AS us, value > 100 AS above FROM events), a AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY user_id ORDER BY us, value), false) AS before FROM o), s AS (SELECT *, max(CASE WHEN above AND NOT before THEN us END) OVER (PARTITION BY user_id ORDER BY us, value) AS session FROM a)"


@G.add(f"WITH {_RUN_US} SELECT user_id, session AS session_id, count(*) AS n_rows, CAST(round(sum(value) * 100) AS BIGINT) AS total FROM s WHERE above GROUP BY ALL")
def stream_threshold(t: Tables) -> DataFrame:
    """Runs of readings over 100 per user; each user's mark ends the last one."""
    rows = streams.threshold_stream(_events_stream(t), "user_id", "value", "ts", 100.0)
    return streams.drain(rows, t.spark, scratch(t.spark, "stream")).select("user_id", "session_id", "n_rows", F.round(c("total") * 100).cast("long").alias("total"))


QUERIES, SQL = G.queries, G.sql
