"""Access to the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` (one Parquet file or folder) below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")
