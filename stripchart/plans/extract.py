"""Pages of drawings to channels in millivolts.

    ops, pages, texts -> polylines -> vendor profile -> orientation -> labels, traces, grid
    -> layout -> names by place -> baseline -> samples

Every step is a DataFrame keyed by page_id; what is known of a page once (profile, rotation, grid,
layout) travels with its rows, so there is one shuffle key throughout. Pages on which nothing is
found stay as rows with a status.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stripchart.functions import arrays
from stripchart.functions.numeric import upper_median
from stripchart.operators import cluster, geometry, match, stats
from stripchart.plans.profiles import profiles
from stripchart.session import settled, ship
from stripchart.sources import drawing

MM_PER_S, MM_PER_MV, RATE, UNIFORM = 25.0, 10.0, 500.0, 0.10
PAGE = ["page_id"]


def oriented(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """Upright polylines with their page's profile and size: page_id, poly_id, pts, colour, width
    of stroke, page_width, page_height, rotation, and the profile's columns."""
    raw = settled(drawing.polylines(ops, pages))
    named = geometry.vendor(pages, raw.withColumn("n", F.size("pts")), PAGE)
    known = named.join(F.broadcast(profiles(ops.sparkSession)), "vendor")
    page = settled(known.drop("viewport", "producer", "creator", "author").withColumnRenamed("width", "page_w").withColumnRenamed("height", "page_h"))
    welds = page.where("weld").select("page_id")
    mixed = raw.join(welds, PAGE, "left_anti").unionByName(_recoloured(raw.join(welds, PAGE, "left_semi"))).withColumn("n", F.size("pts")) if not welds.isEmpty() else raw.withColumn("n", F.size("pts"))
    candidates = geometry.rotation_candidates(mixed, PAGE, "poly_id")
    scored = geometry.rotation_scores(candidates, PAGE).select("page_id", F.col("rotation").alias("_turn"))
    placed = page.join(scored, PAGE, "left").withColumn("rotation", F.coalesce("forced_rotation", "_turn", F.lit(0))).drop("_turn")
    turned = mixed.drop("n").join(placed, PAGE)
    points = F.transform("pts", lambda p: F.struct(*(c.alias(n) for c, n in zip(geometry.rotated(p["x"], p["y"], F.col("rotation"), F.col("page_w"), F.col("page_h")), "xy"))))
    side = F.col("rotation").isin(90, 270)
    upright = turned.withColumn("pts", points)
    return upright.withColumn("page_width", F.when(side, F.col("page_h")).otherwise(F.col("page_w"))).withColumn("page_height", F.when(side, F.col("page_w")).otherwise(F.col("page_h")))


def _recoloured(raw: DataFrame) -> DataFrame:
    """Segments welded into lines; the style of most long ones becomes black."""
    lines = cluster.welded(raw, PAGE, "poly_id")
    style = stats.dominant_group(lines, ["r", "g", "b", "w"], F.size("pts") >= 50, ["poly_id"], PAGE).select("page_id", *(F.col(c).alias(f"_{c}") for c in "rgbw"))
    joined = lines.join(style, PAGE, "left")
    signal = (F.col("r") == F.col("_r")) & (F.col("g") == F.col("_g")) & (F.col("b") == F.col("_b")) & (F.col("w") == F.col("_w"))
    return joined.select("page_id", "poly_id", "pts", *(F.when(signal, 0.0).otherwise(F.col(c)).alias(c) for c in "rgb"), "w")


def grid(boxes: DataFrame) -> DataFrame:
    """One row per page with a grid: spacing_x, spacing_y (points per mm), h_lines, v_lines, and
    h_major, v_major, null where all lines are equally wide."""
    kind = geometry.line_kind(F.col("line_straightness"), F.col("page_width") * F.col("min_h_fraction"), F.col("page_height") * F.col("min_v_fraction"))
    lines = boxes.where(~geometry.is_dark(F.col("black_threshold")) & (F.col("n") >= 2)).withColumn("kind", kind).where("kind is not null")
    placed = lines.select("page_id", "kind", F.when(F.col("kind") == "h", F.col("cy")).otherwise(F.col("cx")).alias("pos"), "w", "dedup_distance", "major_threshold", "min_lines")
    keys = ["page_id", "kind", "dedup_distance", "major_threshold", "min_lines"]
    w = Window.partitionBy(*keys).orderBy("pos", "w")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(w) >= F.col("dedup_distance"), F.lit(True))
    merged = placed.withColumn("_new", new.cast("int")).withColumn("c", F.sum("_new").over(w)).groupBy(*keys, "c").agg(F.avg("pos").alias("pos"), F.max("w").alias("w"))
    marked = stats.width_threshold(merged, PAGE, "w")
    gaps = stats.consecutive_gaps(marked, ["page_id", "kind"], "pos", ["pos"]).groupBy("page_id", "kind").agg(upper_median("gap").alias("gap"))
    sides = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list("pos")).alias("all"), F.array_sort(F.collect_list(F.when(F.col("major"), F.col("pos")))).alias("majors"), F.bool_or(F.col("major").isNotNull()).alias("told")).join(gaps, ["page_id", "kind"])
    good = sides.where(F.col("lines") >= F.col("min_lines")).withColumn("gap", F.when(F.col("gap") > F.col("major_threshold"), F.col("gap") / 5).otherwise(F.col("gap")))
    major = F.when(F.col("told"), F.col("majors"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    both = good.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("_sides"), pick("v", F.col("gap")).alias("spacing_x"), pick("h", F.col("gap")).alias("spacing_y"), pick("h", F.col("all")).alias("h_lines"), pick("v", F.col("all")).alias("v_lines"), pick("h", major).alias("h_major"), pick("v", major).alias("v_major")
    )
    return both.where("_sides = 2").drop("_sides")


def layouts(traces: DataFrame) -> DataFrame:
    """page_id, time_axis, inverted, layout of each page with traces."""
    def runs(axis: str, sign: int) -> Column:
        e = f"forall(sequence(1, size(pts) - 1), i -> {sign} * (pts[i].{axis} - pts[i - 1].{axis}) >= -monotone_tolerance)"
        return F.expr(e)

    w = Window.partitionBy("page_id")
    told = traces.withColumn("_x", runs("x", 1)).withColumn("_y", runs("y", 1) | runs("y", -1)).drop("pts").withColumn("_mid", (F.min("cy").over(w) + F.max("cy").over(w)) / 2)
    new = lambda axis, limit: (F.col(axis) - F.lag(axis).over(w.orderBy(axis)) > limit).cast("int")
    told = told.withColumn("_col", new("cx", F.col("page_width") * F.col("col_fraction"))).withColumn("_row", new("cy", F.col("page_height") * F.col("row_fraction")))
    page = told.groupBy("page_id", "expected_layout", "monotone_share", "page_width", "page_height", "wide_fraction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_x").alias("x"), F.count_if("_y").alias("y"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.min("dx").alias("least_dx"), F.min("dy").alias("least_dy"),
        (F.coalesce(F.sum("_col"), F.lit(0)) + 1).alias("cols"), (F.coalesce(F.sum("_row"), F.lit(0)) + 1).alias("rows"), F.count_if(F.col("cy") < F.col("_mid")).alias("upper"), F.count_if(F.col("cy") >= F.col("_mid")).alias("lower"),
    )
    x_time, y_time = F.col("x") >= F.col("n") * F.col("monotone_share"), F.col("y") >= F.col("n") * F.col("monotone_share")
    axis = F.when(x_time, "x").when(y_time, "y").when(F.col("dx") >= F.col("dy"), "x").otherwise("y")
    inverted = x_time | y_time | (F.col("dx") >= F.col("dy"))
    found = page.withColumn("time_axis", axis).withColumn("inverted", inverted)
    wide = F.when(F.col("time_axis") == "x", F.col("least_dx") > F.col("page_width") * F.col("wide_fraction")).otherwise(F.col("least_dy") > F.col("page_height") * F.col("wide_fraction"))
    many = (F.col("time_axis") == "x") & (F.col("n") >= 12)
    kind = (
        F.when(F.col("expected_layout").isNotNull(), F.col("expected_layout"))
        .when(many & (F.col("cols") >= 4) & (F.col("rows") >= 3), "grid_4x3")
        .when(many & (F.col("cols") == 2) & (F.col("rows") >= 5), "sequential_6x2")
        .when(wide, "stacked_12x1")
        .when(F.col("upper").between(4, 8) & F.col("lower").between(4, 8), "sequential_6x2")
        .otherwise("stacked_12x1")
    )
    return found.select("page_id", "time_axis", "inverted", kind.alias("layout"))


def named(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """traces (with time_axis and layout) with the name of each by its place; in a grid of four
    columns, cells beyond the known ones drop and wide traces are rhythm strips."""
    x_time = F.col("time_axis") == "x"
    stacked = traces.where("layout = 'stacked_12x1'").withColumn("_across", F.when(x_time, F.col("cy")).otherwise(F.col("cx")))
    axes = stacked.select("page_id", "time_axis").distinct()
    across = labels.join(axes, PAGE).select("page_id", "text", F.when(x_time, F.col("y")).otherwise(F.col("x")).alias("_at"))
    one = match.rank_join(stacked, across, PAGE, ["_across", "poly_id"], ["_at", "text"]).withColumn("name", F.coalesce("text", match.lead_at(F.col("rank")))).select(*traces.columns, "name")

    two = match.halves(traces.where("layout = 'sequential_6x2'"), PAGE, "cy")
    enough = labels.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page_id"))).where("_n >= 12").drop("_n")
    sides = match.halves(enough, PAGE, "y").select("page_id", "half", "text", "x", "y", F.lit(True).alias("_full"))
    joined = match.rank_join(two, sides, [*PAGE, "half"], ["cx", "cy", "poly_id"], ["x", "y", "text"])
    full = F.coalesce(F.max("_full").over(Window.partitionBy("page_id")), F.lit(False))
    numbered = match.fallback_name(F.col("rank") + 6 * F.col("half"))
    usual = F.when(~F.col("_has") & (F.col("rank") < 6), match.lead_at(F.col("rank") + 6 * F.col("half"))).otherwise(numbered)
    pair = joined.withColumn("_has", full).withColumn("name", F.coalesce("text", usual)).select(*traces.columns, "name")

    cells = traces.where("layout = 'grid_4x3'")
    medians = cells.groupBy("page_id").agg(upper_median("dx").alias("_m"))
    cells = cells.join(medians, PAGE).withColumn("_strip", F.col("dx") > F.col("_m") * F.col("rhythm_ratio"))
    w = Window.partitionBy("page_id").orderBy("cx", "poly_id")
    new = F.coalesce(F.col("cx") - F.lag("cx").over(w) > F.col("_m") * 0.5, F.lit(False)).cast("int")
    columns = cells.where("not _strip").withColumn("_new", new).withColumn("_col", F.sum("_new").over(w))
    rows = match.ranked(columns, ["page_id", "_col"], ["cy", "poly_id"], "_row").where("_col < 4 and _row < 3")
    grid_names = rows.withColumn("name", match.lead_at((F.col("_col") * 3 + F.col("_row")).cast("int"))).select(*traces.columns, "name")
    strips = cells.where("_strip").withColumn("name", F.lit("II_rhythm")).select(*traces.columns, "name")
    return one.unionByName(pair).unionByName(grid_names).unionByName(strips)


def mode_of(values: np.ndarray) -> float:
    """Middle of the fullest one-unit bin, the first met of equal ones."""
    if len(values) < 2:
        return float(values[0]) if len(values) else 0.0
    bins, first, counts = np.unique(np.floor(values), return_index=True, return_counts=True)
    best = np.lexsort((first, -counts))[0]
    return float(bins[best]) + 0.5


def baseline_of(values: np.ndarray, pulses, majors, lines, spacing: float) -> float:
    """A pulse at the trace's height, else the mode, moved to a major line within 5 mm or to any
    line within one."""
    low, high = values.min(), values.max()
    if pulses is not None and len(pulses):
        near = min(pulses, key=lambda p: (abs((low + high) / 2 - p), p))
        reach = 2 * spacing if spacing and spacing > 0 else (high - low) * 0.25
        if low - reach <= near <= high + reach:
            return float(near)
    guess = mode_of(values)
    for candidates, reach in ((majors, 5 * spacing), (lines, spacing)):
        if candidates is not None and len(candidates) and spacing > 0:
            near = min(candidates, key=lambda p: (abs(p - guess), p))
            if abs(near - guess) <= reach:
                return float(near)
    return guess


def samples_of(time: np.ndarray, value: np.ndarray, baseline: float, per_second: float, per_mv: float, inverted: bool) -> tuple[np.ndarray, float]:
    """(millivolts to four decimals, duration): in time order, reversed where drawn backward; on
    an uneven axis interpolated to 500 a second."""
    if len(time) < 2:
        return np.zeros(0), 0.0
    order = np.argsort(time, kind="stable")
    if len(time) > 10 and time[0] > time[-1] + 1:
        order = order[::-1]
    t, v = time[order], value[order]
    duration = float(abs(t[-1] - t[0]) / per_second)
    gaps = np.diff(t)
    middle = np.sort(gaps)[len(gaps) // 2]
    if not (middle > 0 and (np.abs(gaps - middle) / middle <= UNIFORM).all()):
        n = max(2, int(np.floor(duration * RATE + 0.5)), len(t))
        grid_t = t[0] + np.arange(n) * ((t[-1] - t[0]) / (n - 1))
        lo = np.clip(np.searchsorted(t, grid_t, side="left") - 1, 0, len(t) - 2) if t[-1] >= t[0] else np.zeros(n, int)
        span = t[lo + 1] - t[lo]
        v = v[lo] + (v[lo + 1] - v[lo]) * np.where(span > 0, (grid_t - t[lo]) / np.where(span > 0, span, 1), 0.0)
    mv = (v - baseline) / per_mv
    return np.floor((-mv if inverted else mv) * 10000 + 0.5) / 10000, duration


def converted(traces: DataFrame) -> DataFrame:
    """Named traces with their page's grid to channels: samples, duration, rate, box."""
    ship(traces.sparkSession)
    schema = "page_id long, poly_id int, name string, layout string, vendor string, rotation int, samples array<double>, duration_s double, sample_rate_hz int, x0 double, x1 double, y0 double, y1 double, n_points int"
    kept, lists = ["page_id", "poly_id", "name", "layout", "vendor", "rotation"], ["h_lines", "v_lines", "h_major", "v_major", "pulses"]
    box = ["x0", "x1", "y0", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pts = batch.column("pts")
            offsets, (xs, ys) = pts.offsets.to_numpy(), (c.to_numpy(zero_copy_only=False) for c in pts.values.flatten())
            rows = batch.select(["time_axis", "inverted", "spacing_x", "spacing_y"]).to_pylist()
            known = {c: batch.column(c) for c in lists}
            list_of = lambda c, i: known[c][i].values.to_numpy(zero_copy_only=False) if known[c][i].is_valid else None
            made = []
            for i, r in enumerate(rows):
                x, y, across = xs[offsets[i] : offsets[i + 1]], ys[offsets[i] : offsets[i + 1]], r["time_axis"] == "x"
                time, value = (x, y) if across else (y, x)
                per_second, per_mv, spacing = (r["spacing_x"] * MM_PER_S, r["spacing_y"] * MM_PER_MV, r["spacing_y"]) if across else (r["spacing_y"] * MM_PER_S, r["spacing_x"] * MM_PER_MV, r["spacing_x"])
                base = baseline_of(value, list_of("pulses", i), list_of("h_major" if across else "v_major", i), list_of("h_lines" if across else "v_lines", i), spacing)
                data, duration = samples_of(time, value, base, per_second, per_mv, r["inverted"])
                made.append((data, duration, int(np.floor(len(data) / duration + 0.5)) if len(data) > 1 and duration > 0 else 0, len(x)))
            data, duration, rate, n = zip(*made) if made else ([],) * 4
            columns = [*(batch.column(c) for c in kept), pa.array(data, pa.list_(pa.float64())), pa.array(duration, pa.float64()), pa.array(rate, pa.int32()), *(batch.column(c) for c in box), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    needed = [*kept, "pts", "time_axis", "inverted", *box, "spacing_x", "spacing_y", *lists]
    return traces.select(*needed).mapInArrow(run, schema)


def with_rhythm(channels: DataFrame, target: float = 10.0) -> DataFrame:
    """channels, rhythm strips replaced by one per page named II_rhythm: the drawn one of most
    points, the first of those, else lead II as it is or repeated in whole to about ten seconds."""
    is_strip = F.col("name").rlike("(?i)_rhythm$")
    usual = channels.where(~is_strip)
    drawn = match.top_rows(channels.where(is_strip), PAGE, [F.desc("n_points"), F.col("poly_id")], 1).withColumn("name", F.lit("II_rhythm"))
    second = match.top_rows(usual.where("name = 'II'"), PAGE, [F.col("poly_id")], 1).join(drawn.select("page_id"), PAGE, "left_anti").where("duration_s > 0")
    longer = second.withColumn("_s", arrays.repeated_to("samples", "duration_s", target)).withColumn("duration_s", F.col("duration_s") * F.size("_s") / F.size("samples"))
    made = longer.withColumn("samples", F.col("_s")).drop("_s").withColumn("name", F.lit("II_rhythm")).withColumn("sample_rate_hz", F.floor(F.size("samples") / F.col("duration_s") + 0.5).cast("int"))
    return usual.unionByName(drawn).unionByName(made.select(*usual.columns)).drop("n_points")


def _found(ops: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, signal traces, grids) of drawings."""
    boxes = settled(geometry.boxed(oriented(ops, pages)))
    return boxes, settled(geometry.signal_traces(boxes, PAGE, "poly_id")), settled(grid(boxes))


def _status(pages: DataFrame, traces: DataFrame, ruled: DataFrame) -> DataFrame:
    seen, lined = traces.select("page_id").distinct().withColumn("_t", F.lit(True)), ruled.select("page_id").withColumn("_g", F.lit(True))
    status = pages.select("page_id").join(seen, PAGE, "left").join(lined, PAGE, "left")
    return status.select("page_id", F.when(F.col("_t").isNull(), "NO_TRACES").when(F.col("_g").isNull(), "GRID_NOT_DETECTED").otherwise("ok").alias("status"))


def page_status(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """The status of pages as extract gives it, without their channels."""
    return _status(pages, *_found(ops, pages)[1:])


def extract(ops: DataFrame, pages: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channels, page status) of drawings. ops: see sources.drawing; pages: page_id, width,
    height, viewport, producer, creator, author; texts: page_id, pos, text, x, y.

    Status: ok, NO_TRACES or GRID_NOT_DETECTED. Pages without operators have no traces.
    """
    boxes, traces, ruled = _found(ops, pages)
    arranged = settled(traces.join(layouts(traces), PAGE).join(ruled, PAGE))
    turn = boxes.groupBy("page_id").agg(F.max("rotation").alias("rotation"), F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    found = drawing.labels(texts).join(turn, PAGE)
    x, y = geometry.rotated(F.col("x"), F.col("y"), F.col("rotation"), F.col("page_w"), F.col("page_h"))
    upright = found.select("page_id", "text", x.alias("x"), y.alias("y"))
    kinds = arranged.select("page_id", "time_axis", "inverted", "spacing_x", "spacing_y").distinct()
    strokes = boxes.where(geometry.is_dark(F.col("black_threshold")) & F.col("n").between(F.col("pulse_min_points"), F.col("pulse_max_points"))).join(kinds, PAGE)
    across = F.col("time_axis") == "x"
    strokes = strokes.withColumn("_lo", F.when(across, F.col("y0")).otherwise(F.col("x0"))).withColumn("_hi", F.when(across, F.col("y1")).otherwise(F.col("x1"))).withColumn("_h", F.col("_hi") - F.col("_lo"))
    per_mv = F.when(across, F.col("spacing_y")).otherwise(F.col("spacing_x")) * MM_PER_MV
    pulses = geometry.calibration_pulses(strokes, "_h", per_mv, F.col("pulse_tolerance"), F.col("inverted"), "_lo", "_hi").groupBy("page_id").agg(F.array_sort(F.collect_list("baseline")).alias("pulses"))
    channels = with_rhythm(settled(converted(settled(named(arranged, upright)).join(pulses, PAGE, "left"))))
    return channels, _status(pages, traces, ruled)
