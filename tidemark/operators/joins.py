"""Equi-joins of a key side (left) and a detail side (right), with copied columns and fused aggregates.

``copies`` names left columns that detail rows take over; ``specs`` are aggregates (see
``aggregates``) per key over the detail rows. Outer joins fill what is missing with zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import Spec, aggregate

#: Rows of a task where a large table is dealt out by its keys.
TASK_ROWS = 500_000


def _keyed(left: DataFrame, keys: Sequence[str], copies: Sequence[str]) -> DataFrame:
    return left.select(*keys, *copies)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; makes a key side of a table with repeated keys."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def dealt(df: DataFrame, keys: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as leave each some ``rows``, however large it is.

    Joins and groups by these keys then need no shuffle of their own, whose number of tasks is the session's and doesn't follow the input.
    Rows are counted first, which is only cheap for tables as they are stored, without filters.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def _only_row(left: DataFrame, copies: Sequence[str]) -> DataFrame:
    """The row of a table of one; any other number of rows is an error when the plan runs."""
    one = left.select(F.struct(*copies).alias("row")).limit(2).agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
    return one.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("a join without keys needs one row on its left side"))).alias("row")).select("row.*")


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], copies: Sequence[str] = (), specs: Sequence[Spec] = ()) -> DataFrame:
    """Detail rows with a match; with ``specs`` one row per key. Without keys every row gets the left side's only row."""
    taken = right.drop(*copies)
    out = taken.join(_keyed(left, keys, copies), list(keys)) if keys else taken.crossJoin(F.broadcast(_only_row(left, copies)))
    return aggregate(out, [*keys, *copies], specs) if specs else out


def _zero_where(out: DataFrame, columns: Sequence[str], hit: str) -> DataFrame:
    """Numbers of ``columns`` are 0 in rows without a match; a null of a matched row stays one."""
    kinds = dict(out.dtypes)
    numbers = [c for c in columns if kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    return out.withColumns({c: F.when(F.col(hit).isNull(), F.lit(0).cast(kinds[c])).otherwise(F.col(c)) for c in numbers})


def left_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str], copies: Sequence[str] = ()) -> DataFrame:
    """Matched pairs, and left rows without a match; numbers that are missing are 0."""
    payload = [c for c in right.columns if c not in keys and c not in copies]
    out = _keyed(left, keys, copies).join(right.drop(*copies).withColumn("_hit", F.lit(1)), list(keys), "left")
    return _zero_where(out, payload, "_hit").drop("_hit")


def right_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str], copies: Sequence[str] = ()) -> DataFrame:
    """All detail rows; copies that are missing are 0."""
    out = right.drop(*copies).join(_keyed(left, keys, copies).withColumn("_hit", F.lit(1)), list(keys), "left")
    return _zero_where(out, copies, "_hit").drop("_hit")


def full_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As in SQL, with 0 for missing numbers."""
    out = left.withColumn("_left", F.lit(1)).join(right.withColumn("_right", F.lit(1)), list(keys), "full")
    out = _zero_where(out, [c for c in left.columns if c not in keys], "_left")
    return _zero_where(out, [c for c in right.columns if c not in keys], "_right").drop("_left", "_right")


def full_outer_union(left: DataFrame, right: DataFrame, keys: Sequence[str], copies: Sequence[str] = ()) -> DataFrame:
    """All detail rows as in a right outer join, and all left rows with zeros for the details."""
    details, kinds = right_outer_join(left, right, keys, copies), {**dict(right.dtypes), **dict(left.dtypes)}
    numbers = lambda c: not kinds[c].startswith(("string", "date", "timestamp", "binary", "boolean", "array", "map", "struct"))
    names = [*details.columns, *[c for c in left.columns if c not in details.columns]]

    def all_of(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(0 if numbers(c) else None).cast(kinds[c]).alias(c) for c in names])

    return all_of(details).union(all_of(left))


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def unique_join(left: DataFrame, right: DataFrame, keys: Sequence[str], copies: Sequence[str] = (), check: bool = False) -> DataFrame:
    """Both sides have unique keys; ``check`` makes repeated ones an error, at the cost of an aggregation of each side."""
    if check:
        for side in (left, right):
            if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ValueError(f"keys {list(keys)} are not unique")
    return inner_join(left, right, keys, copies)


def equi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every pair of rows with one key, many to many; of columns in both the left one stays.

    The result has as many rows of a key as the product of both sides': where only sums over the pairs are wanted, ``preaggregated_join``
    makes them without the pairs. The left rows are dealt out evenly first, as a small file's few tasks would make all pairs.
    """
    left = left.repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key)


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """An equality with more conditions: the equality deals out the rows, the rest is tested on matches."""
    return left.join(right, on)


def preaggregated_join(left: DataFrame, right: DataFrame, key: str, left_specs: Sequence[Spec], right_specs: Sequence[Spec]) -> DataFrame:
    """Many to many without the pairs: both sides are aggregated to one row per key first."""
    return aggregate(left, [key], left_specs).join(aggregate(right, [key], right_specs), key)
