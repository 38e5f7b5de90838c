"""Ranks over large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.session import stable


def top_n(df: DataFrame, order: Sequence[Column], n: int, start: int = 1) -> DataFrame:
    """The first ``n`` rows with their rank in ``idx``.

    The cut comes first, each task keeping its own best ``n``; the window then
    numbers ``n`` rows.
    """
    rank = F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)
    return df.orderBy(*order).limit(n).withColumn("idx", rank)


def global_rank(df: DataFrame, order: Sequence[Column], start: int = 1) -> DataFrame:
    """Rank of every row in a total order, in parallel.

    Rows are range-sorted and written once, numbered inside their partition; the
    partition sizes then give each partition its offset.
    """
    place = F.monotonically_increasing_id()
    sorted_rows = stable(df.orderBy(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("idx", F.col("_offset") + within + F.lit(start))
        .drop("_part", "_place", "_offset")
    )
