"""Shared pieces: table access, the shared work folder, texts as Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stripchart.session import shared_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stripchart/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, computes once,
    and survives the loss of executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of df. The schema string names the result columns and types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return over_partitions(df, run, schema)


def over_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to the Arrow batches of each partition of df."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(texts: list, chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about so many characters each, so that what a task builds
    for them at once stays small whatever the batch size."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def text_slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """The same for a column of texts, by bytes; null texts become empty ones."""
    texts = texts.fill_null("")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + size)) + 1
        yield texts.slice(start, stop - start)
        start = stop
