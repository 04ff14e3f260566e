"""Sources: Parquet tables of a scale directory, lake directories, raw captures, streams."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its columns are pruned and its filters pushed down by whoever uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
