"""Operations on sample arrays, one array per channel row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from stripchart.session import ship


def in_order(position: str, value: str) -> Column:
    """Aggregate: the values as an array in the order of position."""
    return F.expr(f"transform(array_sort(collect_list(struct({position} as p, {value} as v))), s -> s.v)")


def _cyclic(samples: str, length: str) -> str:
    return f"(case when {length} <= size({samples}) then slice({samples}, 1, {length}) else transform(sequence(0, {length} - 1), i_ -> {samples}[i_ % size({samples})]) end)"


def cyclic(samples: str, length: str) -> Column:
    """The samples repeated from their start, or cut, to exactly `length` (an int); no samples
    stay none."""
    return F.expr(f"case when size({samples}) = 0 or {length} <= 0 then slice({samples}, 1, 0) else {_cyclic(samples, length)} end")


def fit_to_duration(samples: str, duration: str, target: float) -> Column:
    """Samples of a channel that covers `duration` seconds, so that they cover `target`: cut or
    repeated; unchanged without samples or duration, or within a thousandth of the target."""
    count = f"greatest(1, cast(floor({target}D * size({samples}) / {duration} + 0.5D) as int))"
    keep = f"size({samples}) = 0 or {duration} <= 0 or abs({target}D - {duration}) < 1e-3"
    return F.expr(f"case when {keep} then {samples} else {_cyclic(samples, count)} end")


def repeated_to(samples: str, duration: str, target: float = 10.0) -> Column:
    """A short rhythm channel repeated in whole: as often as makes at least the target, with a
    twentieth of a repeat to spare; null without duration."""
    times = f"cast(greatest(1, ceil({target}D / {duration} - 0.05D)) as int)"
    return F.expr(f"case when {duration} <= 0 then null when {duration} >= {target}D then {samples} else flatten(array_repeat({samples}, {times})) end")


def even_grid(start: str, stop: str, n: str) -> Column:
    """n evenly spaced numbers from start to stop, both included."""
    return F.expr(f"case when {n} <= 0 then array() when {n} = 1 then array(cast({start} as double)) else transform(sequence(0, cast({n} as int) - 1), i_ -> {start} + ({stop} - ({start})) * i_ / ({n} - 1)) end")


def derived(first: str, second: str, name: str) -> Column:
    """A limb lead from leads I and II; null where their lengths differ."""
    rules = {"III": "b - a", "aVR": "-(a + b) / 2", "aVL": "(a - (b - a)) / 2", "aVF": "(b + (b - a)) / 2"}
    return F.expr(f"case when size({first}) = size({second}) then zip_with({first}, {second}, (a, b) -> {rules[name]}) end")


def median_centred(samples: str) -> Column:
    """Samples minus their median (the mean of the middle two where they are even in number)."""
    middle = f"(array_sort({samples})[cast((size({samples}) - 1) div 2 as int)] + array_sort({samples})[cast(size({samples}) div 2 as int)]) / 2"
    return F.expr(f"transform({samples}, x_ -> x_ - {middle})")


@F.pandas_udf(ArrayType(DoubleType()))
def _interpolated(times: pd.Series, values: pd.Series, grids: pd.Series) -> pd.Series:
    def one(t, v, grid):
        if t is None or v is None or grid is None or len(t) < 2 or len(v) < len(t):
            return None
        t, v, grid = (np.asarray(x, float) for x in (t, v, grid))
        at = np.clip(np.searchsorted(t, grid, side="left") - 1, 0, len(t) - 2)
        span = t[at + 1] - t[at]
        share = np.divide(grid - t[at], span, out=np.zeros(len(grid)), where=span != 0)
        return v[at] + (v[at + 1] - v[at]) * share

    return pd.Series([one(*row) for row in zip(times, values, grids)], dtype=object)


def interpolated(times: str, values: str, grid: str) -> Column:
    """Linear interpolation of (times, values) at the points of grid; times ascend. Outside their
    range the first or last segment is extended; two equal times give the earlier value; fewer
    than two points, or a null array, give null."""
    ship(SparkSession.active())
    return _interpolated(F.expr(times), F.expr(values), F.expr(grid))
