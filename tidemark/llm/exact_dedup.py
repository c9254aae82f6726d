"""Exact deduplication with keyed streaming state."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, shared_dir, write_table

#: Rows of one group of copies that are compared with one copy of the kept text.
ROWS_PER_COPY = 1000
#: Digests of copies, eight bytes each, up to which all tasks get them, to leave out texts that have none before these are shuffled.
SENT_DIGESTS = 1_000_000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = digest_of, state: str | None = None) -> DataFrame:
    """One row per row of the documents table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    A stream over the table's files keeps, for each digest of the normalised text, the smallest
    stable identifier, where its content lies (file and row) and the number of rows. The state is in
    RocksDB on the executors' disks and in the checkpoint folder ``state``; it never expires, so a
    later run with the same folder goes on where this one ended: files may have been added to the table,
    none changed or removed. The groups of every batch are kept in the same folder. Rows whose digest is held more than
    once are hits: their full text is compared with the text at the kept row, and texts that differ
    under one digest are grouped anew by their full text.

    Null text counts as empty. Of rows with the same smallest doc_id each counts as kept (they are
    the same row written twice); a null doc_id sorts first. Other columns of the table are not read.
    An empty table gives an empty result.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    state = state or shared_dir(spark, "dedup-state")
    deltas = f"{state.rstrip('/')}/groups"

    own = spark.newSession()  # the state store is set for this stream alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else four megabytes for each partition's store
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = re.sub(r"(\w)/?$", r"[\1]", path)  # as a pattern, the path may also be one file
    held = own.readStream.schema(schema).option("maxFileAge", "36500d").parquet(files).select(digest(text).alias("digest"), place.alias("place")).groupBy("digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    query = held.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{deltas}/batch={n}")).start()
    query.awaitTermination()

    docs = spark.read.schema(schema).parquet(path)
    groups = spark.createDataFrame([], "digest binary, keep struct<doc_id: long, file: string, row: long>, n long")
    if spark._jvm.org.apache.hadoop.fs.Path(deltas).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(deltas)):
        # a digest that a later batch met again is there more than once; the last has the largest count
        groups = spark.read.parquet(deltas).groupBy("digest").agg(F.min("place").alias("keep"), F.max("n").alias("n"))
    copies = write_table(groups.filter("n > 1"), "dedup-copies")  # a table, so that joins can split a large group

    keys = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), digest(text).alias("digest"))
    out = keys.join(copies.select("digest", F.col("keep.doc_id").alias("first"), "n"), "digest", "left").select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "digest")

    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    bodies = docs.select("doc_id", text.alias("body"), digest(text).alias("digest"), *where)
    if copies.count() <= SENT_DIGESTS:
        bodies = bodies.join(F.broadcast(copies.select(F.xxhash64("digest").alias("short"))), F.xxhash64("digest") == F.col("short"), "left_semi")
    hits = write_table(bodies.join(copies, "digest"), "dedup-hits")
    parts = F.ceil(F.col("n") / ROWS_PER_COPY).cast("int")
    first = hits.filter("file = keep.file and row = keep.row").select("digest", F.col("body").alias("held"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    other = hits.withColumn("part", F.pmod(F.xxhash64("file", "row"), parts.cast("long")).cast("int")).join(first, ["digest", "part"]).filter("body <> held")
    if not other.isEmpty():  # one digest for different texts
        exact = other.groupBy("digest", "body").agg(F.min("doc_id").alias("keep2"), F.count(F.lit(1)).alias("n2"))
        fixed = other.select("digest", "body", "doc_id").join(exact, ["digest", "body"]).select("doc_id", F.sha2("body", 256).alias("text_sha256"), "keep2", "n2").dropDuplicates(["doc_id", "text_sha256"])
        less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        out = out.join(less, "digest", "left").join(fixed, ["doc_id", "text_sha256"], "left")
        out = out.withColumns({"keep_id": F.coalesce("keep2", "keep_id"), "group_size": F.coalesce("n2", F.col("group_size") - F.coalesce("less", F.lit(0)))})
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, from a fresh state."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
