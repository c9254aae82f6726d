"""A thin immutable wrapper that chains the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates, joins
from tidemark.sources.tables import scratch

#: Blocks of a table's order, at most, that are looked at one by one.
BLOCKS = 256
#: Rows up to which a head or cut is gathered in one task.
GATHER = 100_000


def concatenate(a: DataFrame, b: DataFrame, table_id: str | None = None) -> DataFrame:
    """All rows of both; numbers that one side lacks are 0. ``table_id`` names a column with 0 or 1 for the side."""
    if table_id:
        a, b = a.withColumn(table_id, F.lit(0).cast("long")), b.withColumn(table_id, F.lit(1).cast("long"))
    missing = [c for c in {*a.columns, *b.columns} if c not in a.columns or c not in b.columns]
    out = a.unionByName(b, allowMissingColumns=True)
    return out.na.fill(0, missing) if missing else out


def distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each combination of ``keys``: the first in ``order``, or any where there is none."""
    return joins.first_per_key(df, keys, order).select(*df.columns) if order else df.dropDuplicates(list(keys))


def distinct_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, within: Sequence[str] = ()) -> DataFrame:
    """1 where a row's keys differ from those of the row before it in ``order`` (of its ``within`` group), else 0.

    Without ``within`` rows are put in blocks of the order, cut at up to ``BLOCKS`` of its own values drawn by hash;
    only the blocks' last rows go through one task.
    """
    own, place = F.struct(*keys), F.struct(*order)
    if within:
        before = F.lag(own).over(Window.partitionBy(*within).orderBy(*order))
        return df.withColumn(out, F.when(before.eqNullSafe(own), 0).otherwise(1).cast("long"))
    cuts = df.select(place.alias("_cut")).distinct().orderBy(F.xxhash64("_cut")).limit(BLOCKS).agg(F.collect_list("_cut").alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_block", F.size(F.filter("_cuts", lambda c: c <= place))).drop("_cuts")
    ends = rows.groupBy("_block").agg(F.max_by(own, place).alias("_end"))
    ends = ends.select("_block", F.lag("_end").over(Window.orderBy("_block")).alias("_end"))
    before = F.coalesce(F.lag(own).over(Window.partitionBy("_block").orderBy(*order)), "_end")
    flag = F.when(before.eqNullSafe(own), 0).otherwise(1).cast("long")
    return rows.join(F.broadcast(ends), "_block").withColumn(out, flag).select(*[c for c in df.columns if c != out], out)


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """``keys`` are (column, ascending)."""
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys])


def _turned(keys: Sequence[tuple[str, bool]]) -> list[tuple[str, bool]]:
    return [(c, not up) for c, up in keys]


def numbered(df: DataFrame, keys: Sequence[tuple[str, bool]], out: str) -> DataFrame:
    """Rows with their number in order, from 0, without one task that meets them all.

    The sorted ranges are written with their places, their sizes are counted, and each place is moved by the ranges before.
    """
    path = scratch(df.sparkSession, "ranges")
    sort(df, keys).withColumn(out, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftrightunsigned(F.col(out), 33)  # the id's upper bits are the range, the lower ones the place in it
    sizes = rows.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")  # one row for each range
    own = F.col(out).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_range", part).join(F.broadcast(sizes), "_range").withColumn(out, F.col("_before") + own).select(*df.columns, out)


def head(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows in order; up to GATHER rows are gathered, more are taken out of the sorted ranges."""
    return sort(df, keys).limit(n) if n <= GATHER else cut(df, keys, 0, n)


def tail(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    return sort(head(df, _turned(keys), n), keys)


def cut(df: DataFrame, keys: Sequence[tuple[str, bool]], begin: int, end: int) -> DataFrame:
    """Rows begin to end (exclusive) in order; the first ``end`` rows are gathered only if they are few, and a deep or wide cut is made on numbered rows."""
    if end <= GATHER:
        return sort(df, keys).limit(end).offset(begin)
    rows = numbered(df, keys, "_row")
    return sort(rows.filter((F.col("_row") >= begin) & (F.col("_row") < end)), [("_row", True)]).drop("_row")


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


class Table:
    """``Table(df).filter(...).sort([("a", True)]).head(3).df``"""

    def __init__(self, df: DataFrame, order: Sequence[tuple[str, bool]] = ()) -> None:
        self.df, self.order = df, list(order)

    def __getitem__(self, name: str) -> Column:
        if name not in self.df.columns:
            raise KeyError(name)
        return self.df[name]

    def _with(self, df: DataFrame) -> Table:
        return Table(df, self.order)

    def filter(self, condition: Column) -> Table:
        return self._with(self.df.filter(condition))

    def project(self, names: Sequence[str]) -> Table:
        return self._with(self.df.select(*names))

    def map_column(self, name: str, function: Callable, kind: str, *inputs: str) -> Table:
        """``name`` from a function of numpy-backed pandas Series, in Arrow batches: for what no built-in function does."""
        return self._with(self.df.withColumn(name, F.pandas_udf(function, kind)(*inputs)))

    def add_columns(self, names: Sequence[str]) -> Table:
        return self._with(self.df.withColumns({n: F.lit(0).cast("long") for n in names}))

    zero = add_columns

    def set(self, name: str, value: Column) -> Table:
        return self._with(self.df.withColumn(name, value))

    def delete_columns(self, names: Sequence[str]) -> Table:
        return self._with(self.df.drop(*names))

    def rename(self, old: str, new: str) -> Table:
        if old not in self.df.columns or new in self.df.columns:
            raise KeyError(f"{old} to {new}")
        return self._with(self.df.withColumnRenamed(old, new))

    def sort(self, keys: Sequence[tuple[str, bool]]) -> Table:
        return Table(sort(self.df, keys), keys)

    def head(self, n: int) -> Table:
        return self._with(head(self.df, self.order, n))

    def tail(self, n: int) -> Table:
        return self._with(tail(self.df, self.order, n))

    def cut(self, begin: int, end: int) -> Table:
        return self._with(cut(self.df, self.order, begin, end))

    def distinct(self, keys: Sequence[str]) -> Table:
        return self._with(distinct(self.df, keys))

    def concatenate(self, other: Table, table_id: str | None = None) -> Table:
        return self._with(concatenate(self.df, other.df, table_id))

    def aggregate(self, keys: Sequence[str], specs: Sequence[aggregates.Spec]) -> Table:
        return self._with(aggregates.aggregate(self.df, keys, specs))

    def inner_join(self, right: Table, keys: Sequence[str], copies: Sequence[str] = (), specs: Sequence[aggregates.Spec] = ()) -> Table:
        return self._with(joins.inner_join(self.df, right.df, keys, copies, specs))

    def left_outer_join(self, right: Table, keys: Sequence[str], copies: Sequence[str] = ()) -> Table:
        return self._with(joins.left_outer_join(self.df, right.df, keys, copies))

    def right_outer_join(self, right: Table, keys: Sequence[str], copies: Sequence[str] = ()) -> Table:
        return self._with(joins.right_outer_join(self.df, right.df, keys, copies))

    def semi_join(self, right: Table, keys: Sequence[str]) -> Table:
        return self._with(joins.semi_join(self.df, right.df, keys))

    def anti_join(self, right: Table, keys: Sequence[str]) -> Table:
        return self._with(joins.anti_join(self.df, right.df, keys))

    def unique_join(self, right: Table, keys: Sequence[str], copies: Sequence[str] = ()) -> Table:
        return self._with(joins.unique_join(self.df, right.df, keys, copies))
