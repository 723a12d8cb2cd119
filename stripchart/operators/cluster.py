"""Clusters of positions by gaps, and islands of rows that continue each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(rows: DataFrame, keys: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def gap_clusters(rows: DataFrame, keys: list[str], position: str, distance: float, order: list[str] | None = None, split_at: bool = False, out: str = "cluster") -> DataFrame:
    """rows with the number of their cluster along position: a new one starts where the gap to
    the row before is over the distance, or with split_at, where it is as large."""
    order = order or [position]
    gap = F.col(position) - F.lag(position).over(Window.partitionBy(*keys).orderBy(*order))
    return _numbered(rows, keys, order, gap >= distance if split_at else gap > distance, out)


def merged_lines(lines: DataFrame, keys: list[str], position: str, width: str, distance: float) -> DataFrame:
    """Lines nearer than the distance to the one before become one: mean position, greatest
    width."""
    found = gap_clusters(lines, keys, position, distance, [position, width], split_at=True)
    return found.groupBy(*keys, "cluster").agg(F.avg(position).alias(position), F.max(width).alias(width), F.count(F.lit(1)).alias("n"))


def welded(segments: DataFrame, keys: list[str], order: str, tolerance: float = 0.5, pts: str = "pts", style: tuple[str, ...] = ("r", "g", "b", "w")) -> DataFrame:
    """Two-point segments that follow each other in drawing order, in one style, each starting
    within the tolerance of where the last ended, become one polyline; others stay.

    Result: keys, order (of the first segment), the style, pts.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    two = F.size(pts) == 2
    end, start = F.element_at(pts, -1), F.col(pts)[0]
    last = F.lag(F.struct(two.alias("two"), end.alias("end"), *style)).over(w)
    near = F.pow(start["x"] - last["end"]["x"], 2) + F.pow(start["y"] - last["end"]["y"], 2) <= tolerance * tolerance
    same = two & last["two"] & near
    for c in style:
        same = same & (F.col(c) == last[c])
    numbered = _numbered(segments, keys, [order], ~same, "_island")
    return numbered.groupBy(*keys, "_island").agg(
        F.min(order).alias(order), *(F.first(c).alias(c) for c in style), F.expr(f"array_sort(collect_list(struct({order} as o, {pts} as p)))").alias("_parts")
    ).select(*keys, order, *style, F.expr("concat(_parts[0].p, flatten(transform(slice(_parts, 2, size(_parts)), s -> slice(s.p, 2, size(s.p)))))").alias(pts))


def runs(rows: DataFrame, keys: list[str], order: list[str], same: list[str], out: str = "run") -> DataFrame:
    """rows numbered by runs of equal values in the columns `same`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return _numbered(rows, keys, order, changed | first, out)
