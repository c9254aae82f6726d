"""Streams against the windows over tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import seconds
from tidemark.streaming import streams, windows

START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def source(spark, tmp_path):
    rows = [("a", 0, 5), ("a", 600, 20), ("a", 1201, 30), ("a", 1300, 2), ("b", 10, 50), ("b", 20, 60), ("b", 5000, 70), ("b", 5010, 1)]
    far = [("a", 90_000, 0), ("b", 90_000, 0)]
    schema = "k string, ts timestamp, v double"
    for n, part in enumerate((rows[:5], rows[5:], far)):
        spark.createDataFrame([(k, START + dt.timedelta(seconds=s), float(v)) for k, s, v in part], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    table = spark.createDataFrame([(k, START + dt.timedelta(seconds=s), float(v)) for k, s, v in rows], schema).withColumn("t", seconds("ts"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), table, f"file://{tmp_path}"


def test_tumbling(spark, source):
    stream, table, folder = source
    out = streams.drain(streams.tumbling_stream(stream, "ts", 3600, ["k"], [F.sum("v").alias("total")]), spark, folder)
    want = windows.tumbling(table, "t", 3600, "window_id").groupBy("k", "window_id").agg(F.sum("v").alias("total"))
    assert sorted(map(tuple, out.select("k", "window_id", "total").collect())) == sorted(map(tuple, want.collect()))


def test_gap(spark, source):
    stream, table, folder = source
    out = streams.drain(streams.gap_stream(stream, "ts", 600, ["k"], [F.count(F.lit(1)).alias("n")]), spark, folder)
    want = windows.gap_session(table, ["k"], "t", 600, "session_id").groupBy("k", "session_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, out.select("k", "session_id", "n").collect())) == sorted(map(tuple, want.collect()))


def test_threshold(spark, source):
    stream, table, folder = source
    out = streams.drain(streams.threshold_stream(stream, "k", "v", "ts", 10.0), spark, folder)
    want = windows.threshold_session(table, ["k"], "v", "t", 10, "s").groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    got = sorted((r.k, r.session_id // 1_000_000, r.n_rows, r.total) for r in out.collect())
    assert got == sorted(map(tuple, want.collect()))


def test_threshold_of_many_keys(spark, tmp_path):
    """Python is called for each bucket of keys, runs stay open across micro-batches, no key or value is a special case."""
    rows = [(k, START + dt.timedelta(seconds=s), v) for k in [*range(60), None, 2**60 + 1] for s, v in ((0, -5.0), (10, -7.0), (20, -20.0), (7300, None), (7310, -1.0), (7310, -30.0), (7320, -2.0), (10_000, -50.0))]
    far = [(k, START + dt.timedelta(days=d), -90.0) for k in [*range(60), None, 2**60 + 1] for d in (5, 9)]
    schema = "k long, ts timestamp, v double"
    for part in (rows[0::8] + rows[1::8], [*rows[2::8], *rows[3::8], *rows[5::8], *rows[4::8]], [*rows[6::8], *rows[7::8], (1, None, 5.0)], far[0::2], far[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = streams.threshold_stream(stream, "k", "v", "ts", -10.0, buckets=5)
    query = out.writeStream.format("parquet").trigger(availableNow=True).option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5
    table = spark.createDataFrame(rows + far, schema).withColumn("t", seconds("ts"))
    want = windows.threshold_session(table, ["k"], "v", "t", -10, "s").groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    got = sorted(((r.k, r.session_id // 1_000_000, r.n_rows, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) == 124
