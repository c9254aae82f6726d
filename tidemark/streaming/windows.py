"""Tumbling, gap-session and threshold-session windows over tables with a whole-number time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import idiv


def tumbling(df: DataFrame, time: str, size: int, out: str) -> DataFrame:
    """``out`` is the number of the window, not its start."""
    return df.withColumn(out, idiv(F.col(time), size))


def gap_session(df: DataFrame, keys: Sequence[str], time: str, gap: int, out: str) -> DataFrame:
    """Each key's rows, split where more than ``gap`` lies between two; ``out`` is the session's first time."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = F.lag(time).over(w)
    opens = F.when(before.isNull() | (F.col(time) - before > gap), F.col(time))
    return df.withColumn("_opens", opens).withColumn(out, F.max("_opens").over(w)).drop("_opens")


def threshold_session(df: DataFrame, keys: Sequence[str], value: str | Column, time: str, threshold: int, out: str, marked: bool = True) -> DataFrame:
    """Runs of consecutive rows of a key with ``value`` over ``threshold``; ``out`` is the run's first time, -1 for other rows.

    Of rows at one time the lower value comes first. With ``marked`` only rows of runs stay.
    """
    w = Window.partitionBy(*keys).orderBy(time, value)
    above = (F.col(value) if isinstance(value, str) else value) > threshold
    df = df.withColumn("_above", F.coalesce(above, F.lit(False)))
    opens = F.when(F.col("_above") & ~F.coalesce(F.lag("_above").over(w), F.lit(False)), F.col(time))
    df = df.withColumn("_opens", opens).withColumn(out, F.when(F.col("_above"), F.max("_opens").over(w)).otherwise(F.lit(-1))).drop("_opens", "_above")
    return df.filter(F.col(out) != -1) if marked else df
