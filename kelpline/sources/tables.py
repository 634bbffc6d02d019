"""Reading the tables of a directory, one Parquet file or folder each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def reader(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{directory}/{name}.parquet")
