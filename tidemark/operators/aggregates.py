"""Grouped, global and running aggregates from specs of (input, output, function)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import idiv

Spec = tuple[str, str, str]

#: ``count`` counts rows, whatever the input; ``copy`` takes a value that is the same in the whole group.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": lambda c: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
    "bit_or": F.bit_or,
    "copy": F.first,
    "avg": lambda c: idiv(F.sum(c), F.count(F.lit(1))),
    "count_distinct": F.count_distinct,
}


def columns(specs: Sequence[Spec]) -> list[Column]:
    return [FUNCTIONS[fn](F.col(c)).alias(out) for c, out, fn in specs]


def aggregate(df: DataFrame, keys: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    """One row per group; without keys, one row in all."""
    return df.groupBy(*keys).agg(*columns(specs)) if keys else df.agg(*columns(specs))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], specs: Sequence[Spec], reverse: bool = False) -> DataFrame:
    """Every row with its group's aggregate up to here, or with ``reverse`` from here on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if reverse else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({out: FUNCTIONS[fn](F.col(c)).over(w) for c, out, fn in specs})


def prefix_sum(df: DataFrame, order: str, value: str, out: str, block: int = 4096, reverse: bool = False, levels: int = 2) -> DataFrame:
    """Sum of ``value`` over all rows up to here by the whole number ``order`` (unique), or from here on.

    Rows are summed in blocks of the order first, and these sums in blocks of blocks; only the sums of the last
    of ``levels`` go through one task.
    """
    end = (Window.currentRow, Window.unboundedFollowing) if reverse else (Window.unboundedPreceding, Window.currentRow)
    if not levels:
        return df.withColumn(out, F.sum(value).over(Window.orderBy(order).rowsBetween(*end)))
    at, own, before = f"_block{levels}", f"_sum{levels}", f"_before{levels}"
    df = df.withColumn(at, idiv(F.col(order), block))
    sums = prefix_sum(df.groupBy(at).agg(F.sum(value).alias(own)), at, own, before, block, reverse, levels - 1)
    sums = sums.select(at, (F.col(before) - F.col(own)).alias(before))
    inner = F.sum(value).over(Window.partitionBy(at).orderBy(order).rowsBetween(*end))
    return df.join(sums, at).withColumn(out, F.col(before) + inner).drop(at, before)


def most_common(df: DataFrame, column: str, classes: int | None = None) -> DataFrame:
    """The most frequent value, of equally frequent ones the largest; only 0 to ``classes`` - 1 count."""
    rows = df if classes is None else df.filter(F.col(column).between(0, classes - 1))
    return rows.groupBy(column).count().orderBy(F.desc("count"), F.desc(column)).limit(1).select(F.col(column).alias("value"))


def chunked_sum(df: DataFrame, position: str, value: str, size: int) -> DataFrame:
    """Sums of each ``size`` rows that follow one another."""
    return df.groupBy(idiv(F.col(position), size).alias("chunk")).agg(F.sum(value).alias("total"))


def dot_product(a: Column, b: Column) -> Column:
    """Of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda acc, x: acc + x)


def custom(df: DataFrame, keys: Sequence[str], column: str, out: str, reduce: Callable, kind: str = "long") -> DataFrame:
    """An associative reducer of a numpy array that no built-in function is.

    It runs on the rows of each partition and key first and then on those results, so that a
    frequent key's rows aren't brought together.
    """
    import pandas as pd

    names = list(keys)

    def part(batches):
        held = [b for b in (pdf.groupby(names, dropna=False)[column].agg(lambda s: reduce(s.to_numpy())).reset_index() for pdf in batches if len(pdf))]
        if held:
            yield pd.concat(held).groupby(names, dropna=False)[column].agg(lambda s: reduce(s.to_numpy())).reset_index()

    rows = df.select(*names, F.col(column).cast(kind).alias(column))
    parts = rows.mapInPandas(part, rows.schema)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names), f"{out} {kind}"])
    return parts.groupBy(*names).applyInPandas(lambda key, pdf: pd.DataFrame([[*key, reduce(pdf[column].to_numpy())]], columns=[*names, out]), schema)
