"""Drawn points against the samples they stand for, and reports of the errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripchart.operators import signal, stats

#: Pixels of a millimetre, millimetres of a millivolt and of a second, and the error that passes.
PX_PER_MM, MM_PER_MV, MM_PER_S, TOLERANCE_MM = 12.0, 10.0, 25.0, 0.5


def measured(points: DataFrame, sample: str, mv: str, baseline_px: str, y_px: str, rate: float = 500.0, mm_per_mv: float = MM_PER_MV, tolerance: float = TOLERANCE_MM) -> DataFrame:
    """points with time_s, expected_mm, actual_mm, error_mm, error_percent and status. Up is where
    y falls; the percentage is 0 where hardly any height is expected."""
    expected, actual = F.col(mv) * mm_per_mv, (F.col(baseline_px) - F.col(y_px)) / PX_PER_MM
    sized = points.withColumns({"time_s": F.col(sample) / rate, "expected_mm": expected, "actual_mm": actual, "error_mm": actual - expected})
    percent = F.when(F.abs("expected_mm") > 0.001, F.col("error_mm") / F.col("expected_mm") * 100.0).otherwise(0.0)
    return sized.withColumns({"error_percent": percent, "status": F.when(F.abs("error_mm") <= tolerance, "PASS").otherwise("FAIL")})


def pulse_check(height_px: Column, width_px: Column, mm_per_mv: float = MM_PER_MV, mm_per_s: float = MM_PER_S, tolerance: float = TOLERANCE_MM) -> Column:
    """The drawn pulse of one millivolt and a fifth of a second: heights, widths, errors, status."""
    height, width = height_px / PX_PER_MM, width_px / PX_PER_MM
    off = lambda found, wanted: F.abs(found - wanted) <= tolerance
    return F.struct(
        F.lit(mm_per_mv).alias("expected_height_mm"), height.alias("actual_height_mm"), (height - mm_per_mv).alias("height_error_mm"),
        F.lit(0.2 * mm_per_s).alias("expected_width_mm"), width.alias("actual_width_mm"), (width - 0.2 * mm_per_s).alias("width_error_mm"),
        F.when(off(height, mm_per_mv) & off(width, 0.2 * mm_per_s), "PASS").otherwise("FAIL").alias("status"),
    )


def summaries(points: DataFrame, keys: list[str], lead: str) -> DataFrame:
    """A row per lead: points, largest error with its sign, mean, deviation, passed, failed, status."""
    return stats.error_summary(points, [*keys, lead], "error_mm", TOLERANCE_MM)


def overall(points: DataFrame, keys: list[str], pulse_status: str | None = None) -> DataFrame:
    """A row per page: FAIL if any point (or the pulse, a column of points) fails, and the largest
    size of an error."""
    failed = F.col("status") == "FAIL"
    if pulse_status:
        failed = failed | F.coalesce(F.col(pulse_status) == "FAIL", F.lit(False))
    return points.groupBy(*keys).agg(F.when(F.bool_or(failed), "FAIL").otherwise("PASS").alias("overall_status"), F.max(F.abs("error_mm")).alias("max_error_mm"), F.count(F.lit(1)).alias("points"))


def reports(points: DataFrame, keys: list[str], lead: str, digits: int = 3) -> DataFrame:
    """keys, overall_status, max_error_mm, report (JSON, leads in their order) and text (a line
    per lead). A page's leads are few, so they are gathered."""
    lines = summaries(points, keys, lead)
    r = lambda c: F.round(c, digits)
    entry = F.struct(F.col(lead).alias("lead_name"), F.col("n").alias("num_points"), r("max_error").alias("max_error_mm"), r("mean_error").alias("mean_error_mm"), r("std_error").alias("std_error_mm"), F.col("passed").alias("num_passed"), F.col("failed").alias("num_failed"), "status")
    text = F.format_string("Lead %s: %d points, max %+.3f mm, mean %+.3f mm, std %.3f mm, passed %d/%d, %s", F.col(lead), "n", "max_error", "mean_error", "std_error", "passed", "n", "status")
    page = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(lead).alias("k"), entry.alias("e"), text.alias("t")))).alias("_leads"))
    made = overall(points, keys).join(page, keys)
    body = F.struct(F.lit(TOLERANCE_MM).alias("tolerance_mm"), F.transform("_leads", lambda x: x["e"]).alias("lead_measurements"), "overall_status", r("max_error_mm").alias("max_amplitude_error_mm"))
    return made.select(*keys, "overall_status", "max_error_mm", F.to_json(body).alias("report"), F.concat_ws("\n", F.transform("_leads", lambda x: x["t"]), F.concat(F.lit("OVERALL STATUS: "), "overall_status")).alias("text"))


def lead_points(drawn: DataFrame, keys: list[str], order: list[str], mv: str, y_px: str, baseline_px: str, points: int = 10, **limits) -> DataFrame:
    """Measured points of each trace of drawn samples: its peaks and samples at regular places.
    Column `index` is a sample's place from 0."""
    return measured(signal.measurement_points(drawn, keys, order, mv, points), "index", mv, baseline_px, y_px, **limits)
