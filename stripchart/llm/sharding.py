"""Fixed virtual slots: records hash into thousands of slots, bytes are summed per slot, and a
versioned slot-to-shard map is edited to even the shards out or to bring in a new one.

Everything here is DataFrame and SQL functions. The map has `slots` rows at most, whatever the
input; only it is gathered (in one SQL fold) and broadcast. Its versions are kept under one path,
a folder each; every edit reads the last version and writes the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stripchart.llm.common import new_path, stored, table

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096
#: Rows that agree in everything are spread over the slots when they hold more than one in so
#: many of a mean slot's bytes; there are SLOTS times as many such groups at most.
FINE = 16
MAP = "slot int, shard int, bytes long, records long, version int"


def virtual_slot(*keys: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str, slots: int = SLOTS) -> DataFrame:
    """One row for each of the slots, empty ones too: slot, bytes, records."""
    found = records.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(F.broadcast(found), "slot", "left").select("slot", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("records"))


def initial_map(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal ranges of slots, before any sizes are looked at."""
    return sizes.select(F.lit(1).alias("version"), "slot", F.expr(f"cast(slot * {shards} div {slots} as int)").alias("shard"), "bytes", "records")


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version: a slot stays where it is while its shard has room below the mean, else
    it moves to the shard with the fewest bytes. Largest slots first, so the last and smallest
    ones level the shards."""
    rows = slot_map.agg(
        F.max("version").alias("version"),
        F.expr("array_sort(collect_list(struct(-bytes as neg, slot, shard, bytes, records)))").alias("s"),
        F.expr(f"cast(ceil(sum(bytes) / {shards}) as bigint)").alias("mean"),
    )
    choose = "if(a.loads[x.shard] + x.bytes <= mean, x.shard, cast(array_position(a.loads, array_min(a.loads)) - 1 as int))"
    fold = f"""aggregate(s,
        struct(array_repeat(0L, {shards}) as loads, cast(array() as array<int>) as shard),
        (a, x) -> transform(array({choose}), t -> struct(
            transform(a.loads, (v, i) -> v + if(i = t, x.bytes, 0L)) as loads,
            concat(a.shard, array(t)) as shard))[0])"""
    return (
        rows.withColumn("to", F.expr(fold))
        .select("version", F.explode(F.expr("arrays_zip(s, to.shard)")).alias("z"))
        .select((F.col("version") + 1).alias("version"), F.col("z.s.slot").alias("slot"), F.col("z.shard").alias("shard"), F.col("z.s.bytes").alias("bytes"), F.col("z.s.records").alias("records"))
    )


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard (number `shards`): slots move only into the new
    shard, from shards that stay at or above the new mean, until it holds the mean."""
    rows = slot_map.agg(
        F.max("version").alias("version"),
        F.expr("array_sort(collect_list(struct(-bytes as neg, slot, shard, bytes, records)))").alias("s"),
        F.expr(f"cast(floor(sum(bytes) / {shards + 1}) as bigint)").alias("mean"),
    ).withColumn("loads", F.expr(f"transform(sequence(0, {shards}), k -> aggregate(filter(s, x -> x.shard = k), 0L, (t, x) -> t + x.bytes))"))
    moves = f"x.bytes > 0 and a.loads[x.shard] - x.bytes >= mean and a.loads[{shards}] + x.bytes <= mean"
    fold = f"""aggregate(s,
        struct(loads, cast(array() as array<int>) as shard),
        (a, x) -> transform(array(if({moves}, {shards}, x.shard)), t -> struct(
            transform(a.loads, (v, i) -> v + if(t != x.shard and i = t, x.bytes, 0L) - if(t != x.shard and i = x.shard, x.bytes, 0L)) as loads,
            concat(a.shard, array(t)) as shard))[0])"""
    return (
        rows.withColumn("to", F.expr(fold))
        .select("version", F.explode(F.expr("arrays_zip(s, to.shard)")).alias("z"))
        .select((F.col("version") + 1).alias("version"), F.col("z.s.slot").alias("slot"), F.col("z.shard").alias("shard"), F.col("z.s.bytes").alias("bytes"), F.col("z.s.records").alias("records"))
    )


def placed(records: DataFrame, slot: str, slot_map: DataFrame, order: list[str], shard: str = "shard", place: str = "place") -> DataFrame:
    """records with their shard and their place in it, gapless from 0: by slot, within a slot by
    `order`. The places of a slot start where those of the shard's slots before it end, so rows
    are only ever sorted within their slot."""
    starts = slot_map.select(
        F.col("slot").alias("_slot"),
        F.col("shard").alias(shard),
        (F.sum("records").over(Window.partitionBy("shard").orderBy("slot")) - F.col("records")).alias("_start"),
    )
    in_slot = F.row_number().over(Window.partitionBy(slot).orderBy(*order)) - 1
    return (
        records.withColumn("_in", in_slot)
        .join(F.broadcast(starts), F.col(slot) == F.col("_slot"))
        .withColumn(place, (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_slot", "_start", "_in")
    )


def in_slots(records: DataFrame, keys: list[str], size: str, slots: int = SLOTS) -> DataFrame:
    """records with `virtual_slot`, stored: the hash of their keys. Of rows that agree in all keys
    and together are heavy each goes to a slot of its own, by its place in the input."""
    total = records.agg(F.sum(size)).first()[0] or 0
    agree = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    heavy = (
        records.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__b"))
        .where((F.col("__n") > 1) & (F.col("__b") * slots * FINE > F.lit(total)))
        .select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__heavy"))
    )
    joined = records.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(heavy), agree, "left")
    slot = virtual_slot(*keys, F.when(F.col("__heavy"), F.col("__place")).otherwise(0), slots=slots)
    return stored(joined.select(*records.columns, slot.alias("virtual_slot")), "in-slots")


def save_version(slot_map: DataFrame, path: str) -> int:
    """Write a version of the map under `path` and return its number; an existing version is
    never overwritten, so of two edits at once one fails."""
    version = slot_map.select(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def versions_of(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions of the map: slot, shard, bytes, records, version."""
    return spark.read.schema(MAP).parquet(path)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    every = versions_of(spark, path)
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0])


def remeasured(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The map with today's bytes and records of its slots."""
    return slot_map.select("version", "slot", "shard").join(sizes, "slot")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, first: bool = True) -> tuple[DataFrame, str]:
    """(placement, path of the map versions) of documents (doc_id, text) in shards of near-equal
    bytes. With first=False the map that is stored at map_path is edited: slots move from it
    only as far as today's sizes ask.

    Size: UTF-8 bytes plus 1; a null text has size 1 and the checksum of no bytes. Null and
    repeated ids are spread by id, checksum and size; rows that agree in all three are
    interchangeable, and are spread by their place in the input where they are heavy. No rows:
    an empty placement. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    records = in_slots(records, ["doc_id", "text_crc32", "size"], "size", slots)
    sizes = stored(slot_sizes(records, "virtual_slot", "size", slots), "slot-sizes")
    map_path = map_path or new_path(spark, "slot-map")
    if first:
        save_version(initial_map(sizes, shards, slots), map_path)
    save_version(rebalanced(remeasured(latest_version(spark, map_path), sizes), shards), map_path)
    current = latest_version(spark, map_path)
    return placed(records, "virtual_slot", current, ["doc_id", "text_crc32", "size"], place="slot"), map_path


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, shard (0 to 7, law `bytes`) and place in it, from the
    stored map's last version. Nulls, repeated rows and empty tables as in shard_documents."""
    rows, _ = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
