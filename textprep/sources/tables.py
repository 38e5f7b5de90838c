"""Stored text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textprep.session import spread


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table; with ``key`` spread over all cores if stored in fewer splits.

    A file of one row group is one task, whatever its size.
    """
    df = spark.read.parquet(path)
    return df if key is None else spread(df, key)
