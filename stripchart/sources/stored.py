"""Stored arrays (compressed archives of named arrays) as binary columns, and deflated streams.

An archive is one value of a binary column. Its arrays are a map from names to element type, shape
and bytes; those of no dimension are single values."""

from __future__ import annotations

import io
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from stripchart.operators import checks
from stripchart.session import ship

_ENTRY = StructType([StructField("name", StringType()), StructField("dtype", StringType()), StructField("shape", ArrayType(IntegerType())), StructField("data", BinaryType())])


# Row by row, as are streams below: Spark then sends a hundred rows at a time, where Arrow batches
# hold 10,000, however long.
@F.udf(BinaryType(), useArrow=False)
def _packed(entries: list | None) -> bytes | None:
    if entries is None:
        return None
    target = io.BytesIO()
    np.savez_compressed(target, **{r["name"]: np.frombuffer(r["data"], r["dtype"]).reshape(tuple(r["shape"])) for r in entries})
    return target.getvalue()


@F.udf(StructType([StructField("entries", ArrayType(_ENTRY)), StructField("error", StringType())]), useArrow=False)
def _unpacked(content: bytes | None) -> tuple[list | None, str | None]:
    try:
        with np.load(io.BytesIO(content or b""), allow_pickle=False) as archive:
            return [(k, str(v.dtype), list(v.shape), v.tobytes()) for k in archive.files for v in [archive[k]]], None
    except Exception as wrong:  # any damage there may be: the archive is told apart, not the job stopped
        return None, f"cannot be read: {type(wrong).__name__}"


def packed(entries: str) -> Column:
    """The archive of an array of structs (name, dtype, shape, data)."""
    ship(SparkSession.active())
    return _packed(F.expr(entries))


def unpacked(content: str) -> Column:
    """struct(entries, error): the arrays of an archive, or why it cannot be read."""
    ship(SparkSession.active())
    return _unpacked(F.expr(content))


def described(entries: str) -> Column:
    """name -> (dtype, shape) of an archive's arrays, as the checks take them."""
    return F.expr(f"map_from_entries(transform({entries}, e -> struct(e.name, struct(e.dtype as dtype, e.shape as shape))))")


def missing_keys(described_by: str) -> Column:
    """Required keys that an archive lacks, for a warning when it is written."""
    wanted = [*checks.METADATA, *checks.GRID, *checks.MAPS, *checks.LABELS]
    absent = F.filter(F.array(*map(F.lit, wanted)), lambda k: ~F.map_contains_key(F.col(described_by), k))
    no_signal = F.expr(f"exists(map_keys({described_by}), k -> startswith(k, '{checks.SIGNAL}'))")
    return F.when(no_signal, absent).otherwise(F.concat(absent, F.array(F.lit("signal_* (at least one)"))))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, entries, error of the archives under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("u", unpacked("content")).select("path", "u.entries", "u.error")


@F.udf(BinaryType(), useArrow=False)
def _deflated(content: bytes | None) -> bytes | None:
    return None if content is None else zlib.compress(content)


@F.udf(BinaryType(), useArrow=False)
def _inflated(content: bytes | None) -> bytes | None:
    try:
        return None if content is None else zlib.decompress(content)
    except zlib.error:
        return None


def deflated(content: Column) -> Column:
    ship(SparkSession.active())
    return _deflated(content)


def inflated(content: Column) -> Column:
    """The stream's bytes; null where they are damaged."""
    ship(SparkSession.active())
    return _inflated(content)
