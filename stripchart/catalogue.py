"""All queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stripchart.queries import drawings, layouts, rasters, reports, texts, traces  # noqa: F401  (registers)
from stripchart.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_mode_baseline"](spark, sf_dir)
