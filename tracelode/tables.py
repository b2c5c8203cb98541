"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; a file or a folder of part files."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
