"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripchart.functions.numeric import seconds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the samples of traces: a trace per user, its time axis in seconds."""
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", seconds("ts").alias("t"), F.col("value").alias("v"))


#: The same in DuckDB, to stand before a query.
SAMPLES_SQL = "with samples as (select user_id, event_id, event_type, epoch(ts) as t, value as v from events)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
