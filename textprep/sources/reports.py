"""Report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a report table; its size is a few rows per class, hence one file."""
    writer = report.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
