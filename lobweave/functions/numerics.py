"""Decimal arithmetic that keeps its digits, and clocks in nanoseconds.

At rest decimals have 18 places; computations narrow them to ``C`` (8 places,
under 1e10), where products and sums are exact. Ratios are taken in double and
rounded to ``RATIO_PLACES``; nulls stand for undefined, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import C, D

RATIO_PLACES = 12


def narrowed(x: Column) -> Column:
    """To the computing type; raises where that would round or overflow."""
    return F.when(x.try_cast(C) != x, F.raise_error(F.concat(F.lit("more than 8 decimal places: "), x.cast("string"))).cast(C)).when(x.isNotNull() & x.try_cast(C).isNull(), F.raise_error(F.concat(F.lit("over 1e10: "), x.cast("string"))).cast(C)).otherwise(x.try_cast(C))


def to_units(x: Column) -> Column:
    """A decimal as a whole number of 1e-8; raises where that would round or overflow."""
    return (narrowed(x) * F.lit(100_000_000)).cast("bigint")


def from_units(x: Column) -> Column:
    return (x.cast("decimal(18,0)") * F.expr("cast(0.00000001 as decimal(8,8))")).cast(C)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null where b is zero."""
    b = b.cast("double")
    return F.round(a.cast("double") / F.when(b != 0, b), RATIO_PLACES)


def stored(x: Column) -> Column:
    """As at rest: rounded half-even to 18 places."""
    return F.bround(x, 18).cast(D)


def utc_date(column: str) -> Column:
    """The UTC day of a column of nanoseconds (integer division first; the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(F.expr(f"{column} div 1000000000")), "yyyy-MM-dd")


def to_ns(timestamp: Column) -> Column:
    """Nanoseconds of a timestamp, with or without a zone (UTC)."""
    return F.unix_micros(timestamp.cast("timestamp")) * 1000


def ms_to_ns(ms: Column) -> Column:
    return ms.cast("bigint") * 1_000_000
