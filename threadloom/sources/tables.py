"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name``'s Parquet data in ``folder``; any path that Spark's readers accept."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
