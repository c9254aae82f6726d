"""The windows on streams, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups of keys that a threshold stream calls Python for.
BUCKETS = 4096


def tumbling_stream(stream: DataFrame, time: str, size_s: int, keys: Sequence[str], aggs: Sequence, late: str = "1 minute") -> DataFrame:
    """Per window and key; ``window_id`` is the window's number. Rows later than ``late`` are dropped."""
    window = F.window(time, f"{size_s} seconds")
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.withColumn("window_id", F.floor(F.unix_seconds("w.start") / size_s).cast("long")).drop("w")


def gap_stream(stream: DataFrame, time: str, gap_s: int, keys: Sequence[str], aggs: Sequence, late: str = "1 minute") -> DataFrame:
    """Per session and key; ``session_id`` is the second of its first row. The session closes when the watermark passes it.

    As in a table, only a distance of *more* than the gap opens a session, so the window reaches a microsecond beyond it.
    """
    window = F.session_window(time, f"{gap_s} seconds 1 microsecond")
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.withColumn("session_id", F.unix_seconds("w.start")).drop("w")


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def threshold_stream(stream: DataFrame, key: str, value: str, time: str, threshold: float, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(key, session_id, n_rows, total) of each run of consecutive rows over ``threshold``, when it has ended.

    A key's rows wait until the watermark has passed them, so that they are met in order of time
    across micro-batches; a run ends with a row at or under the threshold, ``session_id`` is its first time in
    microseconds. Rows behind the watermark, and those without a time, are dropped.

    Python is called for each of ``buckets`` groups of keys, not for each key, and works on their rows at once. A
    run that is still open waits as one row with its first time, sum and number of rows (``_n``, else 0).
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        parts = [p for p in (*held, *(b[["_k", "_t", "_v", "_n"]] for b in batches)) if len(p)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        waits = rows["_t"] >= state.getCurrentWatermarkMs() * 1000
        keep, rows = rows[waits], rows[~waits]
        first = keep["_t"].min() if len(keep) else None
        codes, names = pd.factorize(rows["_k"])
        order = np.lexsort((rows["_v"], rows["_t"], codes))
        codes, times, values, counts = codes[order], *(rows[c].to_numpy()[order] for c in ("_t", "_v", "_n"))
        above = (counts > 0) | (values > threshold)
        same = codes[1:] == codes[:-1]
        opens = above & ~np.concatenate(([False], above[:-1] & same))[: len(above)]
        run = np.cumsum(opens)[above] - 1
        last = np.flatnonzero(above & ~np.concatenate((above[1:] & same, [False]))[: len(above)])
        n = np.bincount(run, weights=np.maximum(counts, 1)[above], minlength=len(last)).astype("int64")
        runs = pd.DataFrame({"_k": np.asarray(names, object)[codes[last]], "_t": times[opens], "_v": np.bincount(run, weights=values[above], minlength=len(last)), "_n": n})
        ended = np.concatenate((same, [False]))[last]
        keep = pd.concat([p for p in (keep, runs[~ended]) if len(p)] or [keep], ignore_index=True)
        if len(keep):
            state.update((_packed(keep.astype({"_k": "category"})),))
        elif state.exists:
            state.remove()
        if first is not None:
            state.setTimeoutTimestamp(max(int(first) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if ended.any():
            yield runs[ended].set_axis(["_k", "session_id", "total", "n_rows"], axis=1)[["_k", "session_id", "n_rows", "total"]]

    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.withWatermark(time, late).filter(F.col(time).isNotNull())
    rows = rows.select(time, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.to_json(F.struct(key)).alias("_k"), us.alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).cast("long").alias("_n"))
    out = rows.groupBy("_bucket").applyInPandasWithState(step, "_k string, session_id long, n_rows long, total double", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("_k", T.StructType([stream.schema[key]]))[key].alias(key), "session_id", "n_rows", "total")


def drain(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns the rows it has finished, from a Parquet sink."""
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
