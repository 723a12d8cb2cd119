"""Joins by place: rank with rank, cell with cell, the nearest, the bracketing pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stripchart.functions.text import LEADS


def ranked(rows: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def rank_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of each key on the left with the i-th on the right; rows of the left without
    a partner have nulls. `rank` starts at 0."""
    return ranked(left, keys, left_order).join(ranked(right, keys, right_order), [*keys, "rank"], "left")


def fallback_name(rank: Column, offset: int = 0) -> Column:
    """L and the one-based place."""
    return F.concat(F.lit("L"), (rank + 1 + offset).cast("string"))


def lead_at(rank: Column) -> Column:
    """The standard lead of that place, L and its place beyond the twelve."""
    return F.coalesce(F.get(F.array(*map(F.lit, LEADS)), rank), fallback_name(rank))


def lead_order(name: Column) -> Column:
    """Place among the standard leads; 99 for any other name."""
    place = F.array_position(F.array(*map(F.lit, LEADS)), name)
    return F.when(place > 0, place - 1).otherwise(99)


def halves(rows: DataFrame, keys: list[str], across: str, out: str = "half") -> DataFrame:
    """0 below the middle of the range of `across` (over the key), 1 from there on."""
    w = Window.partitionBy(*keys)
    middle = (F.min(across).over(w) + F.max(across).over(w)) / 2
    return rows.withColumn(out, F.when(F.col(across) < middle, 0).otherwise(1))


def nearest(left: DataFrame, value: str, right: DataFrame, candidate: str, width: float, keys: list[str] = (), limit: float | None = None) -> DataFrame:
    """left with the nearest candidate within `width` of its value (or `limit`, if smaller), the
    smaller one of a tie, null where none is: an equality join on buckets of that width, not a
    comparison of all with all."""
    reach = width if limit is None else min(width, limit)
    asked = left.select(*keys, value).distinct()  # the value decides, so each is looked up once
    probes = asked.select(*keys, value, F.explode(F.expr(f"transform(array(-1, 0, 1), d -> cast(floor({value} / {width}D) as bigint) + d)")).alias("_b"))
    buckets = right.select(*keys, F.col(candidate).alias("nearest"), F.floor(F.col(candidate) / width).cast("bigint").alias("_b")).distinct()
    distance = F.abs(F.col("nearest") - F.col(value))
    best = probes.join(buckets, [*keys, "_b"]).where(distance <= reach).groupBy(*keys, value).agg(F.min_by("nearest", F.struct(distance, F.col("nearest"))).alias("nearest"))
    return left.join(best, [*keys, value], "left").select(*left.columns, "nearest")


def nearest_in(value: str, candidates: str) -> Column:
    """The first nearest of an array of candidates; null where it is empty."""
    return F.expr(f"aggregate({candidates}, cast(null as double), (best, c) -> if(best is null or abs({value} - c) < abs({value} - best), c, best))")


def bracketed(points: DataFrame, targets: DataFrame, keys: list[str], time: str, value: str, at: str) -> DataFrame:
    """Linear interpolation at target times between the points around them, per key; points and
    targets are merged into one order, so there is no join by range. Targets outside the points'
    range have a null value."""
    source = points.select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_kind"))
    asked = targets.select(*keys, F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    point = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    back = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = source.unionByName(asked).withColumn("_lo", F.last(point, True).over(back)).withColumn("_hi", F.last(point, True).over(ahead))
    lo, hi = F.col("_lo"), F.col("_hi")
    share = F.when(hi["t"] == lo["t"], 0.0).otherwise((F.col("_t") - lo["t"]) / (hi["t"] - lo["t"]))
    return both.where("_kind = 1").select(*keys, F.col("_t").alias(at), (lo["v"] + (hi["v"] - lo["v"]) * share).alias(value))


def coalesced_profile(rows: DataFrame, profiles: DataFrame, name: str, fields: dict[str, object]) -> DataFrame:
    """rows with each field of their named profile, or its default where the profile is unknown
    or leaves it open. Profiles are a dimension of a few rows."""
    joined = rows.join(F.broadcast(profiles), name, "left")
    for field, default in fields.items():
        joined = joined.withColumn(field, F.coalesce(F.col(field), F.lit(default)))
    return joined


def mapped(value: Column, pairs: dict[str, str]) -> Column:
    """value through a fixed map; what it does not hold passes through."""
    return F.coalesce(F.create_map(*(F.lit(x) for p in pairs.items() for x in p))[value], value) if pairs else value


def inverted(mapping: str) -> Column:
    """A map's values to its keys."""
    return F.expr(f"map_from_arrays(map_values({mapping}), map_keys({mapping}))")


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in the given order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")
