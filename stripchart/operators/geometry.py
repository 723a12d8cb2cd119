"""Drawings: colours, boxes, rotations, lines and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stripchart.operators.match import top_rows


def unit_colour(r: str, g: str, b: str) -> list[Column]:
    """Components in 0..1: where any is over 1 all are divided by 255."""
    big = F.greatest(r, g, b) > 1
    return [F.when(big, F.col(c) / 255.0).otherwise(F.col(c)).alias(c) for c in (r, g, b)]


def is_dark(limit, r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.greatest(r, g, b) < limit


def rotated(x: Column, y: Column, angle: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point after turning a page of the given size by 0, 90, 180 or 270 degrees."""
    new_x = F.when(angle == 90, height - y).when(angle == 180, width - x).when(angle == 270, y).otherwise(x)
    new_y = F.when(angle == 90, x).when(angle == 180, height - y).when(angle == 270, width - x).otherwise(y)
    return new_x, new_y


def affine(matrix: str, x: str, y: str) -> Column:
    """A point through [a, b, c, d, e, f]."""
    return F.expr(f"struct({matrix}[0] * {x} + {matrix}[2] * {y} + {matrix}[4] as x, {matrix}[1] * {x} + {matrix}[3] * {y} + {matrix}[5] as y)")


def affine_product(first: str, second: str) -> Column:
    """first after second, as six numbers."""
    a, b = first, second
    return F.expr(
        f"array({a}[0]*{b}[0]+{a}[2]*{b}[1], {a}[1]*{b}[0]+{a}[3]*{b}[1], {a}[0]*{b}[2]+{a}[2]*{b}[3], {a}[1]*{b}[2]+{a}[3]*{b}[3], {a}[0]*{b}[4]+{a}[2]*{b}[5]+{a}[4], {a}[1]*{b}[4]+{a}[3]*{b}[5]+{a}[5])"
    )


def boxed(polylines: DataFrame, pts: str = "pts") -> DataFrame:
    """polylines with the box of their points: x0, x1, y0, y1, cx, cy, dx, dy and n."""
    out = polylines
    for name, axis, best in (("x0", "x", "min"), ("x1", "x", "max"), ("y0", "y", "min"), ("y1", "y", "max")):
        out = out.withColumn(name, F.expr(f"array_{best}(transform({pts}, p -> p.{axis}))"))
    return out.select("*", F.expr("(x0 + x1) / 2").alias("cx"), F.expr("(y0 + y1) / 2").alias("cy"), F.expr("x1 - x0").alias("dx"), F.expr("y1 - y0").alias("dy"), F.size(pts).alias("n"))


def signal_traces(polylines: DataFrame, keys: list[str], order: str, dark: str = "black_threshold", least: str = "min_points", ratio: str = "min_size_ratio", most: str = "max_traces") -> DataFrame:
    """Dark polylines with more points than `least`, at least `ratio` of the longest one's, the
    longest `most` of each page (drawing order breaks ties). The limits are columns."""
    dark_ones = polylines.where(is_dark(F.col(dark)) & (F.col("n") > F.col(least)))
    longest = F.max("n").over(Window.partitionBy(*keys))
    kept = dark_ones.withColumn("_longest", longest).where(F.col("n") >= F.col("_longest") * F.col(ratio)).drop("_longest")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), order))
    return kept.withColumn("_place", place).where(F.col("_place") <= F.col(most)).drop("_place")


def line_kind(straight, least_across, least_down) -> Column:
    """h or v for a polyline that is a grid line, by its box; null for any other."""
    return F.when((F.col("dy") < straight) & (F.col("dx") > least_across), "h").when((F.col("dx") < straight) & (F.col("dy") > least_down), "v")


def calibration_pulses(polylines: DataFrame, height: str, points_per_mv, tolerance, inverted: Column, low: str, high: str) -> DataFrame:
    """Polylines as high as one millivolt, within a share of it, and the line they start from."""
    near = F.abs(F.col(height) - points_per_mv) < points_per_mv * tolerance
    return polylines.where(near).withColumn("baseline", F.when(inverted, F.col(high)).otherwise(F.col(low)))


_STEPS = {"s0": "b.x - a.x", "s90": "a.y - b.y", "s180": "a.x - b.x", "s270": "b.y - a.y"}


def rotation_candidates(polylines: DataFrame, keys: list[str], order: str, pts: str = "pts") -> DataFrame:
    """The 30 longest dark polylines of at least 50 points, of pages with at least 4 of them: keys,
    order, n, and whether x never falls by more than a point, as they are (s0) and turned by 90,
    180 and 270 degrees. How far x moves between two points does not depend on the page's size.
    Points stay where they are; only what is told of them is sorted."""
    pairs = lambda step: f"zip_with(slice({pts}, 1, greatest(size({pts}) - 1, 0)), slice({pts}, 2, greatest(size({pts}) - 1, 0)), (a, b) -> {step})"
    rises = [F.expr(f"forall({pairs(step)}, d -> d >= -1)").alias(name) for name, step in _STEPS.items()]
    told = polylines.where(is_dark(0.4) & (F.col("n") >= 50)).select(*keys, order, "n", *rises)
    long = top_rows(told, keys, [F.desc("n"), F.col(order)], 30)
    return long.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_c >= 4").drop("_c")


def rotation_scores(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each page the number of candidates that rise each way, and the rotation that wins."""
    scored = candidates.groupBy(*keys).agg(*(F.count_if(F.col(name)).alias(name) for name in _STEPS), F.count(F.lit(1)).alias("n"))
    good = lambda c: (F.col(c) >= F.greatest(F.lit(4.0), F.col("n") / 2)) & (F.col(c) > 1.5 * F.col("s0"))
    score = lambda c: F.when(good(c), F.col(c)).otherwise(-1)
    best = F.greatest(*(score(c) for c in ("s90", "s180", "s270")))
    turn = F.when(best < 0, 0).when(score("s90") == best, 90).when(score("s180") == best, 180).otherwise(270)
    return scored.withColumn("rotation", turn)


def vendor(pages: DataFrame, polylines: DataFrame, keys: list[str]) -> DataFrame:
    """The maker of each page's drawing, by a cascade from its metadata over its size and the
    kinds of its polylines to its grid's colour."""
    dark_long = (F.col("n") >= 50) & is_dark(0.4)
    red = (F.col("r") > 0.9) & (F.col("g") < 0.1) & (F.col("b") < 0.1) & (F.col("n") >= 2)
    pink = (F.col("r") > 0.8) & F.col("g").between(0.5, 0.8) & (F.col("g") > 0.5) & (F.col("g") < 0.8) & (F.col("b") > 0.5) & (F.col("b") < 0.8) & (F.col("n") >= 2)
    counts = polylines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("n") == 2).alias("_two"), F.count_if(dark_long).alias("_dark"), F.bool_or(red).alias("_red"), F.bool_or(pink).alias("_pink"))
    meta = F.lower(F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit("")), F.coalesce("author", F.lit(""))))
    pieces = (F.col("_all") > 3000) & (F.col("_two") / F.col("_all") > 0.8)
    name = (
        F.when(meta.contains("muse"), "GE MUSE")
        .when(meta.contains("matplotlib"), "PTB-XL")
        .when(F.greatest("width", "height") > 2000, "Mortara/Burdick")
        .when(pieces & (F.col("_dark") >= 6), "AMPS-LLC")
        .when(pieces, "Vectracor")
        .when(F.col("_red"), "Schiller")
        .when(F.col("_pink"), "Schiller CS")
        .otherwise("Unknown")
    )
    return pages.join(counts, keys, "left").withColumn("vendor", name).drop("_all", "_two", "_dark", "_red", "_pink")
