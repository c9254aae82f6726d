"""Rows by their place: gathers, permutations and views. A vector is a table with a whole-number ``place`` from 0.

A permutation is a table (place, target): what stands at ``place`` goes to ``target``. All of it is joins and
arithmetic on places, so nothing is sorted or brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(rows: DataFrame, at: DataFrame, place: str = "place") -> DataFrame:
    """For each row of ``at`` (place, source) the row of ``rows`` at ``source``, at its new place; a source may come up more than once."""
    held = rows.withColumnRenamed(place, "_source")
    out = at.select(F.col(place), F.col("source").alias("_source")).join(held, "_source")
    return out.select(*[c for c in rows.columns])


def extract_valid(rows: DataFrame, valid: str) -> DataFrame:
    """Rows whose flag is 1, without the flag; places keep their gaps."""
    return rows.filter(F.col(valid) == 1).drop(valid)


def apply_permutation(rows: DataFrame, permutation: DataFrame, place: str = "place") -> DataFrame:
    """Every row at its target."""
    moved = permutation.select(F.col("place").alias("_from"), F.col("target").alias("_to"))
    out = rows.join(moved, rows[place] == moved["_from"])
    return out.select(*[F.col("_to").alias(c) if c == place else F.col(c) for c in rows.columns])


def invert(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("target").alias("place"), F.col("place").alias("target"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The permutation that does ``first``, then ``second``."""
    then = second.select(F.col("place").alias("target"), F.col("target").alias("_last"))
    return first.join(then, "target").select("place", F.col("_last").alias("target"))


def reverse(rows: DataFrame, size: int, place: str = "place") -> DataFrame:
    return rows.withColumn(place, F.lit(size - 1).cast("long") - F.col(place))


def slice_view(rows: DataFrame, begin: int, end: int, step: int = 1, place: str = "place") -> DataFrame:
    """Places begin, begin + step, ... before ``end``, numbered anew from 0."""
    p = F.col(place)
    kept = rows.filter((p >= begin) & (p < end) & ((p - begin) % step == 0))
    return kept.withColumn(place, F.expr(f"({place} - {begin}) div {step}"))


def alternating_view(rows: DataFrame, keep: int, skip: int, place: str = "place") -> DataFrame:
    """``keep`` places, then not the next ``skip``, and so on, numbered anew."""
    own = f"{place} % {keep + skip}"
    return rows.filter(F.expr(f"{own} < {keep}")).withColumn(place, F.expr(f"({place} div {keep + skip}) * {keep} + {own}"))


def repeated_view(rows: DataFrame, times: int, place: str = "place") -> DataFrame:
    """Every row ``times`` times, one after another."""
    out = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    return out.withColumn(place, F.col(place) * times + F.col("_turn")).drop("_turn")


def cyclic_view(rows: DataFrame, size: int, times: int, place: str = "place") -> DataFrame:
    """The whole vector of ``size`` places ``times`` times, one after another."""
    out = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    return out.withColumn(place, F.col(place) + F.col("_turn") * size).drop("_turn")


def directed_view(rows: DataFrame, size: int, forward: bool, place: str = "place") -> DataFrame:
    """The vector as it is, or from its end."""
    return rows if forward else reverse(rows, size, place)


def chunked_dot(rows: DataFrame, a: str, b: str, size: int, place: str = "place") -> DataFrame:
    """(chunk, product): the sum of products over each ``size`` places that follow one another."""
    return rows.groupBy(F.expr(f"{place} div {size}").alias("chunk")).agg(F.sum(F.col(a) * F.col(b)).alias("product"))
