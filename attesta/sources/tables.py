"""Reading the Parquet tables a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set at ``sf_dir``; the path works for any Hadoop file system."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
