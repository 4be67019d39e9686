"""Hybrid logical clocks as columns: physical milliseconds << 16 | 16-bit counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(ms: Column, counter: Column) -> Column:
    return F.shiftleft(ms.cast("long"), 16).bitwiseOR(counter.cast("long"))


def millis(hlc: Column) -> Column:
    return F.shiftright(hlc, 16)


def counter(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit(65535).cast("long"))


def observed(own: Column, other: Column) -> Column:
    """The clock after seeing another: past both. If the physical part stays, the counter moves on,
    and its overflow carries into the milliseconds."""
    top = F.greatest(own, other)
    return F.when(millis(top) == millis(own), top + 1).otherwise(top)


def before(a: Column, b: Column) -> Column:
    """Order of two clocks given as unsigned 64-bit numbers or their decimal text; null beyond."""
    kind = "decimal(20,0)"
    fits = lambda c: (c >= 0) & (c <= F.lit("18446744073709551615").cast(kind))
    x, y = a.try_cast(kind), b.try_cast(kind)
    return F.when(fits(x) & fits(y), x < y)
