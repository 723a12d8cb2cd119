"""Aggregations over the samples of a trace. Keys are column names; every operator returns one
row per key unless it says otherwise, and combines on the map side before it shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stripchart.functions.numeric import upper_median


def histogram_mode(points: DataFrame, keys: list[str], value: str, position: list[str], out: str = "baseline") -> DataFrame:
    """Middle of the one-unit bin with most values; of equally full bins the one that was met
    first in the order of position. A single value is its own mode."""
    binned = points.select(*keys, F.floor(value).cast("double").alias("_bin"), F.struct(*position).alias("_pos"), F.col(value).alias("_v"))
    bins = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"), F.min("_v").alias("_v"))
    # bins are few: the earliest of the fullest by two aggregates that need no order
    best = bins.groupBy(*keys).agg(F.max("_n").alias("_max"), F.sum("_n").alias("_all"))
    full = bins.join(best, keys).where(F.col("_n") == F.col("_max"))
    return full.groupBy(*keys).agg(F.min_by("_bin", "_first").alias("_bin"), F.max("_all").alias("_all"), F.min("_v").alias("_v")).select(*keys, F.when(F.col("_all") == 1, F.col("_v")).otherwise(F.col("_bin") + 0.5).alias(out))


def consecutive_gaps(points: DataFrame, keys: list[str], value: str, order: list[str], out: str = "gap") -> DataFrame:
    """Each row but the first of its key with the distance to the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return points.withColumn(out, F.col(value) - F.lag(value).over(w)).where(F.col(out).isNotNull())


def spacing(points: DataFrame, keys: list[str], value: str, order: list[str], tolerance: float = 0.10) -> DataFrame:
    """upper median gap and whether the axis is uniform: every gap within `tolerance` of it."""
    gaps = consecutive_gaps(points, keys, value, order)
    medians = gaps.groupBy(*keys).agg(upper_median("gap").alias("median_gap"), F.min("gap").alias("_least"), F.max("gap").alias("_most"), F.count(F.lit(1)).alias("gaps"))
    off = lambda c: F.abs(F.col(c) - F.col("median_gap")) / F.col("median_gap") <= tolerance
    return medians.select(*keys, "gaps", "median_gap", F.coalesce((F.col("median_gap") > 0) & off("_least") & off("_most"), F.lit(False)).alias("uniform"))


def bounding_box(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    box = points.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n"))
    return box.select("*", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))


def monotone(points: DataFrame, keys: list[str], x: str, y: str, order: list[str], tolerance: float = 0.5) -> DataFrame:
    """Whether x never falls, y never falls and y never rises by more than the tolerance from
    one point to the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stepped = points.select(*keys, (F.col(x) - F.lag(x).over(w)).alias("_dx"), (F.col(y) - F.lag(y).over(w)).alias("_dy"))
    always = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return stepped.groupBy(*keys).agg(always(F.col("_dx") >= -tolerance).alias("x_up"), always(F.col("_dy") >= -tolerance).alias("y_up"), always(F.col("_dy") <= tolerance).alias("y_down"))


def dominant_group(rows: DataFrame, group: list[str], counted, first: list[str], keys: list[str] = ()) -> DataFrame:
    """The group with most rows where `counted` holds; of equal ones that met first."""
    sizes = rows.where(counted).groupBy(*keys, *group).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*first)).alias("_first"))
    named = F.struct(*group)
    best = F.max_by(named, F.struct(F.col("n"), *( -F.col(f"_first.{c}") for c in first)))
    return sizes.groupBy(*keys).agg(best.alias("g"), F.max("n").alias("n")).where("n is not null").select(*keys, *(F.col(f"g.{c}").alias(c) for c in group), "n")


def width_threshold(lines: DataFrame, keys: list[str], width: str) -> DataFrame:
    """lines with `major`: wider than the middle between the least and the greatest width of
    their key; null where all are equally wide."""
    limits = lines.groupBy(*keys).agg(F.min(width).alias("_lo"), F.max(width).alias("_hi")) if keys else lines.agg(F.min(width).alias("_lo"), F.max(width).alias("_hi"))
    joined = lines.join(F.broadcast(limits)) if not keys else lines.join(limits, keys)
    return joined.withColumn("major", F.when(F.col("_hi") > F.col("_lo"), F.col(width) > (F.col("_lo") + F.col("_hi")) / 2)).drop("_lo", "_hi")


def error_summary(points: DataFrame, keys: list[str], error: str, limit: float) -> DataFrame:
    """Number, greatest error by size with its sign, mean, population deviation, passes and
    failures against the limit, and a status."""
    ok = F.abs(error) <= limit
    found = points.groupBy(*keys).agg(
        F.count(error).alias("n"), F.max_by(error, F.struct(F.abs(error), F.col(error))).alias("max_error"), F.avg(error).alias("mean_error"), F.stddev_pop(error).alias("std_error"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed")
    )
    return found.withColumn("status", F.when(F.col("n") == 0, "NO_DATA").when(F.col("failed") > 0, "FAIL").otherwise("PASS"))


def mask_statistics(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pixels of 255, of 0 and of other values, the share of 255, whether only 0 and 255 occur."""
    v = F.col(value)
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v == 255).alias("signal"), F.count_if(v == 0).alias("background"), F.count_if(~v.isin(0, 255)).alias("other"), (F.count_if(v == 255) * 100.0 / F.count(F.lit(1))).alias("percent"), F.bool_and(v.isin(0, 255)).alias("is_binary")
    )


def timing(runs: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
