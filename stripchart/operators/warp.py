"""Masks carried through a coordinate map, pixel by pixel, so that a page is never one row.

A map has a row for each pixel of a page (keys, y, x) and where it goes on another page (u, v). Its
inverse is made by scattering, the last drawn pixel first, and filling what nothing reached from
its neighbours; masks are then sampled through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripchart.session import settled

#: Rounds in which holes take the mean of the filled pixels around them.
ROUNDS = 5
_AROUND = "flatten(transform(sequence(-1, 1), dy -> transform(sequence(-1, 1), dx -> struct(least(greatest(y + dy, 0), height - 1) as y, least(greatest(x + dx, 0), width - 1) as x))))"


def scattered(moves: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, from_x, from_y: for each pixel of pages (keys, width, height) that moves (keys,
    y, x, u, v) reach, rounded half to even, the last of them in the order of lines. Null and
    outside positions are dropped."""
    put = moves.select(*keys, F.struct("y", "x").alias("source"), F.rint("u").cast("long").alias("x"), F.rint("v").cast("long").alias("y"))
    inside = put.hint("merge").join(pages, keys).where("x >= 0 and x < width and y >= 0 and y < height")
    last = inside.groupBy(*keys, "y", "x").agg(F.max("source").alias("source"))
    return last.select(*keys, "y", "x", F.col("source.x").cast("double").alias("from_x"), F.col("source.y").cast("double").alias("from_y"))


def filled(inverse: DataFrame, pages: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """inverse with its holes filled, a ring each round, by the mean of the filled among the nine
    pixels round a hole, those of the rim standing for what lies outside. Holes further in stay out."""
    place = [*keys, "y", "x"]
    done = settled(inverse)
    every = pages.withColumn("y", F.explode(F.expr("sequence(0L, height - 1L)"))).withColumn("x", F.explode(F.expr("sequence(0L, width - 1L)")))
    holes = settled(every.join(done, place, "left_anti"))
    for _ in range(rounds):
        near = holes.select(*keys, F.struct("y", "x").alias("hole"), F.explode(F.expr(_AROUND)).alias("p")).select(*keys, "hole", "p.*")
        means = near.join(done, place).groupBy(*keys, "hole").agg(F.avg("from_x").alias("from_x"), F.avg("from_y").alias("from_y"))
        new = settled(means.select(*keys, "hole.*", "from_x", "from_y"))
        if new.isEmpty():
            break
        done = settled(done.unionByName(new))
        holes = settled(holes.join(new, place, "left_anti"))
    return done


def sampled(mask: DataFrame, inverse: DataFrame, keys: list[str], names: list[str] = ()) -> DataFrame:
    """keys, names, y, x, value of a mask (keys, names, y, x, value; absent pixels are 0) seen
    through an inverse map: bilinear, 0 outside, rounded half to even; zeros are left out."""
    corners = F.expr("""flatten(transform(sequence(0, 1), dy -> transform(sequence(0, 1), dx -> struct(cast(floor(from_y) + dy as bigint) as my, cast(floor(from_x) + dx as bigint) as mx,
        if(dy = 1, from_y - floor(from_y), 1 - from_y + floor(from_y)) * if(dx = 1, from_x - floor(from_x), 1 - from_x + floor(from_x)) as weight))))""")
    asked = inverse.select(*keys, "y", "x", F.explode(corners).alias("c")).select(*keys, "y", "x", "c.*").where("weight > 0")
    own = mask.select(*keys, *names, F.col("y").cast("long").alias("my"), F.col("x").cast("long").alias("mx"), "value")
    seen = asked.hint("merge").join(own, [*keys, "my", "mx"]).groupBy(*keys, *names, "y", "x").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    # sums of weights are exact to some 12 digits in any order
    return seen.withColumn("value", F.rint(F.round("value", 9)).cast("int")).where("value > 0")


def warped(mask: DataFrame, moves: DataFrame, pages: DataFrame, keys: list[str], names: list[str] = ()) -> DataFrame:
    """mask carried along by a forward map onto pages of another size."""
    return sampled(mask, filled(scattered(moves, pages, keys), pages, keys), keys, names)
