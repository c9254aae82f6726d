"""Helpers shared by the text operators: shared working tables and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that go to Python at a time.
BATCH_ROWS = 1000
#: Fixed value: the characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session in a single process may leave that unset: a folder of its own machine is made for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Python gets BATCH_ROWS rows at a time at most, beside Spark's own bound by bytes; then the session is as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = int(before)
    spark.conf.set(key, BATCH_ROWS if rows <= 0 else min(rows, BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_table = path
    return out


def drop_table(table: DataFrame) -> None:
    """Deletes what ``write_table`` wrote, once nothing is left that reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._work_table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows of an Arrow batch in chunks of some ``most`` bytes of text, at least one row each: (rows, their bytes, first byte of each and the end).

    Nothing is copied or decoded. Null counts as empty. Spark itself bounds a batch's bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    texts = batch.column(column)
    if not len(texts):
        return
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
        yield range(lo, hi), flat[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]
        lo = hi


def release_memory() -> None:
    """Gives what a worker has freed back to the system; its heap would else stay as large as its largest task has made it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(docs: DataFrame) -> int:
    """Characters in all texts; sizes the number of buckets."""
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Each partition first contracts its own edges to a spanning forest; then labels move to
    neighbours and are shortened (label of the label) until nothing changes. A hub's edges are
    only ever joined and aggregated with min, so no neighbourhood is held in one place.
    """
    spark = edges.sparkSession

    def forest(batches):
        import pandas as pd

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for pdf in batches:
            for x, y in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
            if len(parent) > 1_000_000:
                yield pd.DataFrame([(x, root(x)) for x in parent], columns=["u", "v"])
                parent.clear()
        if parent:
            yield pd.DataFrame([(x, root(x)) for x in parent], columns=["u", "v"])

    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    tree = write_table(pairs.mapInPandas(forest, "u long, v long").filter("u <> v").distinct(), "forest")
    both = tree.select("u", "v").union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
    held = write_table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        labels = held.select("u", "c")
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").groupBy("u").agg(F.min("d").alias("d"))
        step = labels.join(near, "u").select("u", "c", F.least("c", "d").alias("n"))
        jump = labels.select(F.col("u").alias("n"), F.col("c").alias("e"))
        step = write_table(step.join(jump, "n").select("u", F.least("n", "e").alias("c"), (F.least("n", "e") < F.col("c")).alias("moved")), "labels")
        drop_table(held)
        held = step
        if step.filter("moved").isEmpty():
            drop_table(tree)
            return step.select(F.col("u").alias("node"), F.col("c").alias("component"))
