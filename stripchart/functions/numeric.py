"""Rounding and ordering rules that differ from Spark's defaults, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, step: float = 1.0) -> Column:
    """Round to a multiple of 1/step, halves toward positive infinity (-2.5 -> -2)."""
    scaled = value.cast("double") * F.lit(float(step)) + F.lit(0.5)
    return F.floor(scaled).cast("double") / F.lit(float(step))


def half_even(value: Column) -> Column:
    """Round to whole numbers, halves to the even neighbour (0.5 -> 0, 1.5 -> 2)."""
    return F.rint(value)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def upper_median(value: str) -> Column:
    """Aggregate over a column or SQL expression: element n // 2 of the sorted values. It is the
    mirror image of the lower median, which Spark counts with map-side partial results."""
    return F.expr(f"-(percentile_disc(0.5) within group (order by -({value})))")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"cast(datediff(to_date({ts}), date'1970-01-01') as double) * 86400 + hour({ts}) * 3600 + minute({ts}) * 60 + cast(extract(second from {ts}) as double)")
