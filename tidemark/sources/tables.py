"""Tables: Parquet folders, CSV with a declared header, generated and single-column data."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); only a session in a single process may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


class Tables:
    """The tables of one folder, read when they are asked for: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def from_columns(spark: SparkSession, columns: dict[str, Sequence[int]]) -> DataFrame:
    """A table of whole numbers from plain columns of one length."""
    sizes = {len(c) for c in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns differ in length: {sorted(sizes)}")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in columns])
    return spark.createDataFrame(list(zip(*columns.values())), schema)


def zero_table(spark: SparkSession, names: Sequence[str], rows: int) -> DataFrame:
    return spark.range(rows).select(*[F.lit(0).cast("long").alias(n) for n in names])


def counter_table(spark: SparkSession, name: str, rows: int, start: int = 0) -> DataFrame:
    """Whole numbers one after another."""
    return spark.range(start, start + rows).select(F.col("id").alias(name))


def random_table(spark: SparkSession, ranges: dict[str, tuple[int, int]], rows: int, seed: int = 0) -> DataFrame:
    """Uniform whole numbers, each column in [low, high)."""
    return spark.range(rows).select(*[(F.floor(F.rand(seed + i) * (hi - lo)) + lo).cast("long").alias(n) for i, (n, (lo, hi)) in enumerate(ranges.items())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV whose header names the columns, in any order; a name that ``schema`` lacks, or that is missing, is an error."""
    want = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = spark.read.option("header", True).csv(path).columns  # reads the header only
    if sorted(names) != sorted(want.names):
        raise ValueError(f"header {names} does not fit the schema {want.names}")
    by = {f.name: f for f in want.fields}
    read = spark.read.schema(T.StructType([by[n] for n in names])).option("header", True).option("mode", "FAILFAST").csv(path)
    return read.select(*want.names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_column(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_column(spark: SparkSession, path: str, name: str, kind: str = "long") -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast(kind).alias(name))


def masked(df: DataFrame, valid: str, seed: int = 0, fill: int = (1 << 63) - 1) -> DataFrame:
    """Rows in random order; those that aren't valid show ``fill`` everywhere."""
    shown = [F.when(F.col(valid) == 1, F.col(c)).otherwise(F.lit(fill)).alias(c) for c in df.columns if c != valid]
    return df.orderBy(F.rand(seed)).select(*shown)
