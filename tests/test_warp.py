"""Masks through a map against plain arrays, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripchart.operators import warp
from stripchart.session import settled


def plain(mask, u, v, width, height, rounds):
    """Scatter in the order of lines, rounds of means, bilinear samples, all by loops."""
    inverse = {}
    for y, x in np.ndindex(u.shape):
        to = (int(np.rint(v[y, x])), int(np.rint(u[y, x])))
        if 0 <= to[1] < width and 0 <= to[0] < height:
            inverse[to] = (float(y), float(x))
    for _ in range(rounds):
        new = {}
        for y, x in np.ndindex(height, width):
            if (y, x) not in inverse:
                near = [(min(max(y + a, 0), height - 1), min(max(x + b, 0), width - 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
                near = [inverse[p] for p in near if p in inverse]
                if near:
                    new[y, x] = tuple(np.mean(near, axis=0))
        inverse |= new
    out = {}
    for (y, x), (sy, sx) in inverse.items():
        total = sum(max(0, 1 - abs(sy - a)) * max(0, 1 - abs(sx - b)) * float(mask[a, b]) for a, b in np.ndindex(mask.shape))
        if np.rint(round(total, 9)) > 0:
            out[y, x] = int(np.rint(round(total, 9)))
    return out


@pytest.mark.parametrize("rounds", [1, 5])
def test_against_arrays(spark, rounds):
    rng = np.random.default_rng(rounds)
    y, x = np.mgrid[:7, :9]
    u, v = x * 2.25 - 1 + rng.integers(-8, 8, x.shape) / 16, y * 1.75 + rng.integers(-8, 8, x.shape) / 16 - 0.5
    mask = rng.integers(0, 2, x.shape) * 200
    cells = [(1, int(a), int(b)) for a, b in np.ndindex(x.shape)]
    moves = spark.createDataFrame([(*c, float(u[c[1:]]), float(v[c[1:]])) for c in cells] + [(1, 0, 0, None, 1.0), (2, 0, 0, 90.0, 1.0)], "k int, y long, x long, u double, v double")
    pixels = spark.createDataFrame([(*c, int(mask[c[1:]])) for c in cells if mask[c[1:]]], "k int, y long, x long, value int")
    pages = spark.createDataFrame([(1, 20, 12), (2, 5, 5)], "k int, width int, height int")
    inverse = warp.filled(warp.scattered(moves, pages, ["k"]), pages, ["k"], rounds)
    found = {(r["y"], r["x"]): r["value"] for r in warp.sampled(pixels, inverse, ["k"]).collect()}
    assert found == plain(mask, u, v, 20, 12, rounds) and len(found) > 20
    assert warp.warped(pixels.where("false"), moves, pages, ["k"]).count() == 0
    assert warp.warped(pixels, moves.where("false"), pages, ["k"]).count() == 0


def test_polygon_spans_of_odd_outlines(spark):
    """A triangle cut at the page's edge; null, short and broken outlines."""
    from stripchart.operators import raster

    rows = [(1, [(-2.0, 0.0), (4.0, 0.0), (-2.0, 6.0)]), (2, None), (3, [(0.0, 0.0), (1.0, 1.0)]), (4, [(0.0, 0.0), (None, 3.0), (3.0, 3.0)]), (5, [])]
    shapes = spark.createDataFrame(rows, "k long, pts array<struct<x: double, y: double>>")
    pages = spark.createDataFrame([(k, 3, 3) for k in range(1, 6)], "k long, width int, height int")
    found = raster.polygon_spans(shapes, pages, ["k"]).collect()
    assert sorted((r["k"], r["y"], r["x0"], r["x1"]) for r in found) == [(1, 0, 0, 3), (1, 1, 0, 3), (1, 2, 0, 2)]


def test_no_table_of_pixels_is_gathered(spark):
    """Pixels exploded from few pages look small to the planner; they are never broadcast."""
    pages = spark.range(3).select(F.col("id").alias("k"), F.lit(8).alias("width"), F.lit(6).alias("height"))
    grid = pages.withColumn("y", F.explode(F.expr("sequence(0L, 5L)"))).withColumn("x", F.explode(F.expr("sequence(0L, 7L)")))
    moves = grid.select("k", "y", "x", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"))
    inverse = settled(warp.scattered(moves, pages, ["k"]))
    seen = warp.sampled(grid.select("k", "y", "x", F.lit(9).alias("value")), inverse, ["k"])
    assert seen.count() == 3 * 48
    for made in (seen, warp.scattered(moves, pages, ["k"]), grid.join(inverse, ["k", "y", "x"], "left_anti"), inverse.select("k", F.explode(F.array("y", "x"))).join(pages, "k")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
