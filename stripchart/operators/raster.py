"""Masks from coordinates, and coordinate maps.

Masks are sparse: a row per pixel that is set (keys, y, x, value), so pages are never held whole
and masks merge by grouping. Coordinate maps are one row per image, read in numpy one at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripchart.functions.text import LEADS, base_lead
from stripchart.session import ship


def inside(points: DataFrame, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    """Points on the page, as whole pixels."""
    px = points.withColumn(x, F.floor(x).cast("int")).withColumn(y, F.floor(y).cast("int"))
    return px.where(F.col(x).between(0, width - 1) & F.col(y).between(0, height - 1))


def merged(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest value of each pixel, combined before it is shuffled."""
    return pixels.groupBy(*keys, "y", "x").agg(F.max("value").alias("value"))


def dots(points: DataFrame, keys: list[str], width: int, height: int, radius: int = 0) -> DataFrame:
    """Points as cones of a radius in pixels: 255 in the middle, falling evenly to the rim."""
    offsets = [(dx, dy, round(255 * (1 - (dx * dx + dy * dy) ** 0.5 / (radius + 1)))) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    kernel = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(v).alias("v")) for dx, dy, v in offsets))
    spread = points.select(*keys, F.floor("x").cast("int").alias("_px"), F.floor("y").cast("int").alias("_py"), F.explode(kernel).alias("_k"))
    pixels = spread.select(*keys, (F.col("_py") + F.col("_k.dy")).alias("y"), (F.col("_px") + F.col("_k.dx")).alias("x"), F.col("_k.v").alias("value"))
    return merged(pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)), keys)


def strokes(lines: DataFrame, keys: list[str], width: int, height: int, thickness: int = 1, pts: str = "pts") -> DataFrame:
    """Polylines as pixels of 255: each segment in steps of at most a pixel, as thick as asked."""
    segments = lines.where(F.size(pts) > 1).select(*keys, F.explode(F.expr(f"transform(sequence(1, size({pts}) - 1), i -> struct({pts}[i - 1] as a, {pts}[i] as b))")).alias("_s"))
    long = F.greatest(F.abs(F.col("_s.b.x") - F.col("_s.a.x")), F.abs(F.col("_s.b.y") - F.col("_s.a.y")))
    steps = segments.select(*keys, "_s", F.greatest(F.lit(1), F.ceil(long)).cast("int").alias("_n")).withColumn("_i", F.explode(F.expr("sequence(0, _n)")))
    at = lambda axis: F.col(f"_s.a.{axis}") + (F.col(f"_s.b.{axis}") - F.col(f"_s.a.{axis}")) * F.col("_i") / F.col("_n")
    centre = steps.select(*keys, F.rint(at("x")).cast("int").alias("_cx"), F.rint(at("y")).cast("int").alias("_cy")).distinct()
    low, high = -((thickness - 1) // 2), thickness // 2
    wide = centre.withColumn("x", F.explode(F.expr(f"transform(sequence({low}, {high}), d -> _cx + d)"))).withColumn("y", F.explode(F.expr(f"transform(sequence({low}, {high}), d -> _cy + d)")))
    seen = wide.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return merged(seen.withColumn("value", F.lit(255)), keys)


def boxes(shapes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Filled rectangles x0..x1, y0..y1 (whole pixels, both ends) as pixels of 255."""
    cut = shapes.select(*keys, *(F.least(F.greatest(F.col(c).cast("int"), F.lit(0)), F.lit(top - 1)).alias(c) for c, top in (("x0", width), ("x1", width), ("y0", height), ("y1", height)))).where("x0 <= x1 and y0 <= y1")
    return merged(cut.withColumn("x", F.explode(F.expr("sequence(x0, x1)"))).withColumn("y", F.explode(F.expr("sequence(y0, y1)"))).withColumn("value", F.lit(255)), keys)


def channel_class(name: Column) -> Column:
    """Number of a channel's class: its lead's place; null for unknown ones, which drop."""
    place = F.array_position(F.array(*map(F.lit, LEADS)), base_lead(name))
    return F.when(place > 0, (place - 1).cast("int"))


def classes(pixels: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Pixels of named channels by class, merged over the segments of a lead."""
    return merged(pixels.withColumn("class", channel_class(F.col(name))).where("class is not null").drop(name), [*keys, "class"])


def overlay(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.select(*keys, "y", "x", F.when(F.col("value") == 255, F.array(F.lit(255), F.lit(0), F.lit(0))).alias("rgb"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def binary(r: Column, g: Column, b: Column, level: float = 128) -> Column:
    return F.when(luma(r, g, b) > level, 255).otherwise(0)


# --- coordinate maps: one row per image (key, width, height, map_x, map_y as row-major doubles) ---


def identity_maps(images: DataFrame) -> DataFrame:
    """images (with width, height) with maps that leave every pixel where it is."""
    n = "sequence(0, width * height - 1)"
    return images.withColumn("map_x", F.expr(f"transform({n}, i -> cast(i % width as double))")).withColumn("map_y", F.expr(f"transform({n}, i -> cast(i div width as double))"))


def extended_borders(grid: np.ndarray, border: int = 50) -> np.ndarray:
    """Values within a border replaced by carrying on, in straight lines, what lies inside it:
    columns first, then rows."""
    out = grid.astype(float).copy()
    for axis in (1, 0):
        view = np.moveaxis(out, axis, 0)
        b = min(border, (len(view) - 2) // 2)
        if b < 1:
            continue
        steps = np.arange(1, b + 1).reshape(-1, *([1] * (view.ndim - 1)))
        view[:b] = (view[b] - steps * (view[b + 1] - view[b]))[::-1]
        view[-b:] = view[-b - 1] + steps * (view[-b - 1] - view[-b - 2])
    return out


def sampled(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples, the rim repeated outside."""
    h, w = grid.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), x - x0, y - y0
    return (grid[y0, x0] * (1 - fx) + grid[y0, x1] * fx) * (1 - fy) + (grid[y1, x0] * (1 - fx) + grid[y1, x1] * fx) * fy


def inverse_of(map_x: np.ndarray, map_y: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of a forward map by fixed-point rounds on its displacement."""
    h, w = map_x.shape
    gy, gx = np.mgrid[:h, :w].astype(float)
    dx, dy = map_x - gx, map_y - gy
    x, y = gx - dx, gy - dy
    for _ in range(rounds):
        x, y = gx - sampled(dx, x, y), gy - sampled(dy, x, y)
    return x, y


def inverse_maps(images: DataFrame) -> DataFrame:
    """images with map_x, map_y inverted; an image is one row and fits a task."""
    ship(images.sparkSession)

    def run(frames):
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                shape = (int(r.height), int(r.width))
                x, y = inverse_of(np.reshape(r.map_x, shape), np.reshape(r.map_y, shape))
                made.append((x.ravel(), y.ravel()))
            yield frame.assign(map_x=[m[0] for m in made], map_y=[m[1] for m in made])

    return images.mapInPandas(run, images.schema)


def composed(images: DataFrame, apply) -> DataFrame:
    """images with the function `apply` (arrays x, y -> x, y) run on every mapped coordinate."""
    ship(images.sparkSession)

    def run(frames):
        for frame in frames:
            pairs = [apply(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(frame["map_x"], frame["map_y"])]
            yield frame.assign(map_x=pd.Series([p[0] for p in pairs], index=frame.index), map_y=pd.Series([p[1] for p in pairs], index=frame.index))

    return images.mapInPandas(run, images.schema)


# --- fixed values: classes of a page's masks; leads follow from 2 on ------------------------------
CLASSES = {"grid_combined": 1, "reference_pulse": 14, "lead_labels": 15, "medical_text": 16, "black_square": 17, "etiquette": 18, "handwriting": 19}
GRID_PARTS, FIRST_LEAD, SIGNAL_MASK, ALL_SIGNALS = ["grid_major", "grid_minor"], 2, "signal_", "signal_all"
# --- end of fixed values -----------------------------------------------------------------------


def page_masks(keys: list[str], width: int, height: int, points: DataFrame | None = None, lines: DataFrame | None = None, shapes: DataFrame | None = None, radius: int = 0, thickness: int = 1) -> DataFrame:
    """All masks of pages: keys, mask, y, x, value. Each input has keys and the name of its mask:
    points (x, y), lines (pts) and filled boxes (x0, y0, x1, y1)."""
    own = [*keys, "mask"]
    made = []
    if points is not None:
        made.append(dots(points, own, width, height, radius))
    if lines is not None:
        made.append(strokes(lines, own, width, height, thickness))
    if shapes is not None:
        made.append(boxes(shapes, own, width, height))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return merged(out, own)


def multiclass(pixels: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """Pixels of named masks (keys, mask, y, x, value) by class, 1 to 19, merged over the segments
    of a lead; parts of the grid count where the page has no whole one; unknown masks drop."""
    name = F.col(mask)
    lead = F.when(name.startswith(SIGNAL_MASK) & (name != ALL_SIGNALS), channel_class(F.expr(f"substring({mask}, {len(SIGNAL_MASK) + 1})")) + FIRST_LEAD)
    known = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))[name]
    whole = pixels.where(name == "grid_combined").select(*keys).distinct().withColumn("_whole", F.lit(True))
    part = F.when(name.isin(GRID_PARTS) & F.col("_whole").isNull(), CLASSES["grid_combined"])
    classed = pixels.join(whole, keys, "left").withColumn("class", F.coalesce(known, lead, part)).where("class is not null")
    return merged(classed.select(*keys, "class", "y", "x", "value"), [*keys, "class"])


def background(foreground: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, xs: the columns of each line of pages (keys, width, height) in which no class has a
    value; a line is bounded by the page's width."""
    lines = pages.select(*keys, "width", F.explode(F.expr("sequence(0, cast(height as int) - 1)")).alias("y"))
    taken = foreground.where("value > 0").groupBy(*keys, "y").agg(F.collect_set("x").alias("_taken"))
    every = F.expr("sequence(0, cast(width as int) - 1)")
    free = F.when(F.col("_taken").isNull(), every).otherwise(F.array_except(every, "_taken"))
    return lines.join(taken, [*keys, "y"], "left").select(*keys, "y", free.alias("xs"))


def polygon_spans(polygons: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1: the runs of pixels x0 to x1 - 1 that polygons (keys, pts) cover on pages
    (keys, width, height) by the even-odd rule, a corner on a line counting for the side below.
    Runs may repeat a pixel of other polygons of the same keys only; null or short outlines and those with a null corner give none."""
    edge = "transform(pts, (p, i) -> struct(p as a, pts[(i + 1) % size(pts)] as b))"
    edges = polygons.where("size(pts) > 2 and forall(pts, p -> p.x is not null and p.y is not null)").withColumn("shape", F.monotonically_increasing_id()).select(*keys, "shape", F.explode(F.expr(edge)).alias("e"))
    ends = edges.join(pages, keys).withColumn("top", F.expr("greatest(ceil(least(e.a.y, e.b.y)), 0L)")).withColumn("end", F.expr("least(ceil(greatest(e.a.y, e.b.y)), cast(height as bigint))"))
    lines = ends.where("top < end").withColumn("y", F.explode(F.expr("sequence(top, end - 1)")))
    met = lines.withColumn("c", F.expr("e.a.x + (y - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y)"))
    sides = met.groupBy(*keys, "shape", "y").agg(F.sort_array(F.collect_list("c")).alias("cs"), F.first("width").alias("width"))
    runs = sides.select(*keys, "y", "width", F.explode(F.expr("transform(sequence(0, size(cs) - 1, 2), i -> struct(cs[i] as l, cs[i + 1] as r))")).alias("s"))
    cut = runs.select(*keys, "y", F.expr("greatest(ceil(s.l), 0L)").alias("x0"), F.expr("least(ceil(s.r), cast(width as bigint))").alias("x1"))
    return cut.where("x0 < x1")
