"""Windows over samples in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peaks(samples: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """The k largest (by size, the earlier of equal ones) of the samples that stand strictly
    above or below both neighbours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    turns = ((v > before) & (v > after)) | ((v < before) & (v < after))
    found = samples.withColumn("_turn", turns).where("_turn").drop("_turn")
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs(value)), *order))).where(F.col("place") <= k)


def measurement_points(samples: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Samples to measure: up to half of n are peaks, the rest every so many-th sample, and the
    first and last. Column `index` is the sample's place from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    indexed = samples.withColumn("index", F.row_number().over(w) - 1).withColumn("_n", size)
    high = peaks(indexed, keys, order, value, n // 2).select(*keys, "index", F.lit(True).alias("_peak"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / (n - n // 2)))
    joined = indexed.join(high, [*keys, "index"], "left")
    regular = (F.col("index") % step == 0) | (F.col("index") == F.col("_n") - 1)
    return joined.where(regular | F.col("_peak")).withColumn("is_peak", F.coalesce("_peak", F.lit(False))).drop("_n", "_peak")


def moving_average(samples: DataFrame, keys: list[str], order: list[str], value: str, taps: int = 100, out: str = "smooth") -> DataFrame:
    """Mean over `taps` samples, taps // 2 of them before; what is missing at the ends is 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(taps // 2), taps - taps // 2 - 1)
    return samples.withColumn(out, F.sum(value).over(w) / taps)


def centred(samples: DataFrame, keys: list[str], value: str, out: str = "centred") -> DataFrame:
    """value minus the key's median (the mean of the middle two where they are even)."""
    medians = samples.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("_m"))
    return samples.join(medians, keys).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def millivolts(samples: DataFrame, value: str, baseline: str, points_per_mv: float, inverted: bool = False, out: str = "mv") -> DataFrame:
    """(value - baseline) / points per millivolt, to 4 decimals with halves up."""
    raw = (F.col(value) - F.col(baseline)) / points_per_mv
    return samples.withColumn(out, F.floor((-raw if inverted else raw) * F.lit(10000.0) + F.lit(0.5)).cast("double") / 10000.0)


def channel_metadata(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Longest duration (10 where none is positive), highest rate (500), samples of the longest
    channel, channels."""
    best = channels.groupBy(*keys).agg(F.max("duration_s").alias("d"), F.max("sample_rate_hz").alias("r"), F.max(F.size("samples")).alias("samples"), F.count(F.lit(1)).alias("channels"))
    return best.select(*keys, F.when(F.col("d") > 0, F.col("d")).otherwise(10.0).alias("duration_s"), F.when(F.col("r") > 0, F.col("r")).otherwise(500).alias("sample_rate_hz"), "samples", "channels")
