"""Counter arithmetic: integers wrap at 64 bits, a real operand makes a real."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF, _FULL = "9223372036854775808", "18446744073709551616"


def wrapped(x: Column) -> Column:
    """An exact decimal total as a wrapping 64-bit integer."""
    wide = lambda v: F.lit(v).cast("decimal(38,0)")
    return (F.pmod(x.cast("decimal(38,0)") + wide(_HALF), wide(_FULL)) - wide(_HALF)).cast("bigint")


def add_wrapping(a: Column, b: Column) -> Column:
    return wrapped(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def sum_wrapping(x: Column) -> Column:
    return wrapped(F.sum(x.cast("decimal(20,0)")))


def wrap_int(v: int) -> int:
    return (v + (1 << 63)) % (1 << 64) - (1 << 63)
