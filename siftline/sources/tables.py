"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns that a query does not use are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
