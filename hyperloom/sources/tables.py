"""Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
