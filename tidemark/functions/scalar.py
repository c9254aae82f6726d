"""Whole-number, bit and fixed-point expressions on columns, all of them built-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_BITS = 16


def cents(c: str | Column) -> Column:
    """Money or a share as hundredths: sums of whole numbers don't depend on their order."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def whole(c: str) -> Column:
    return F.round(F.col(c)).cast("long")


def flag(condition: Column) -> Column:
    """A condition as 0 or 1."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def idiv(a: Column, b: Column | int) -> Column:
    """Quotient cut towards zero; null where ``b`` is 0."""
    return F.call_function("div", a, F.nullif(F.lit(b) if isinstance(b, int) else b, F.lit(0)))


def remainder(a: Column, b: Column) -> Column:
    """With the sign of ``a``; null where ``b`` is 0."""
    return a % F.nullif(b, F.lit(0))


def multiplex(select: Column, a: Column, b: Column) -> Column:
    """``b`` where ``select`` is 1, else ``a``."""
    return F.when(select == 1, b).otherwise(a)


def ltz(c: Column) -> Column:
    return flag(c < 0)


def gtez(c: Column) -> Column:
    return flag(c >= 0)


def low_bit(c: Column) -> Column:
    return c.bitwiseAND(F.lit(1).cast("long"))


def extend_low_bit(c: Column) -> Column:
    """-1 (all bits) where the lowest bit is set, else 0."""
    return -low_bit(c)


def parity(c: Column) -> Column:
    return (F.bit_count(c) % 2).cast("long")


def bucket_code(c: Column, bounds: Sequence[int]) -> Column:
    """Bit i is set where ``c`` reaches bound i."""
    out = F.lit(0).cast("long")
    for i, bound in enumerate(bounds):
        out = out + F.shiftleft(flag(c >= bound), i)
    return out


def fixed(c: Column, bits: int = FRACTION_BITS) -> Column:
    """A number in fixed point."""
    return F.round(c * (1 << bits)).cast("long")


def fixed_mul(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    return F.shiftright(a * b, bits)


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp, rounded down."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def wrap(c: Column, bits: int) -> Column:
    """Two's-complement value of the lowest ``bits`` bits."""
    half = 1 << (bits - 1)
    return F.pmod(c + half, F.lit(1 << bits).cast("long")) - half


def bit(c: Column, i: int) -> Column:
    return F.getbit(c, F.lit(i)).cast("long")


def bits(c: Column, n: int) -> Column:
    """The lowest ``n`` bits, lowest first, as an array of 0 and 1."""
    return F.array(*[bit(c, i) for i in range(n)])


def mask(c: Column, n: int) -> Column:
    """Only the bits of ``c`` that are set in ``n``."""
    return c.bitwiseAND(F.lit(n).cast("long"))


def pack(flags: Sequence[Column]) -> Column:
    """Up to 63 columns of 0 and 1 as one number, the first as the lowest bit."""
    out = F.lit(0).cast("long")
    for i, x in enumerate(flags):
        out = out.bitwiseOR(F.shiftleft(x.cast("long"), i))
    return out


def times_float(c: Column, factor: float, bits: int = FRACTION_BITS) -> Column:
    """A whole number or one in fixed point times a known number, rounded to ``bits`` fraction bits first; cut downwards."""
    return F.shiftright(c * F.lit(round(factor * (1 << bits))).cast("long"), bits)
