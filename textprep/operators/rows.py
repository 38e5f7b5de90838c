"""Row-level filters and projections, for use with ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F


def drop_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null(df: DataFrame, column: str = "text") -> DataFrame:
    return df.na.drop(subset=[column])


def keep_where(df: DataFrame, column: str, test: Callable[[Column], Column]) -> DataFrame:
    """Keep rows whose ``column`` passes ``test``, without computing the column again.

    A plain filter on a computed text is pushed below the computation, repeating it
    there: the cleaning would run twice. A generator of no or one value stays put.
    """
    return df.withColumn(column, F.explode(F.filter(F.array(column), test)))


def drop_blank(df: DataFrame, column: str = "clean_text") -> DataFrame:
    return keep_where(df, column, lambda t: F.trim(t) != "")


def min_length(df: DataFrame, column: str = "clean_text", length: int = 10) -> DataFrame:
    """Keep texts of more than ``length`` characters."""
    return keep_where(df, column, lambda t: F.length(t) > length)


def with_row_id(df: DataFrame, rank: int = 0) -> DataFrame:
    """Stable key ``(source_rank, id)`` given at the scan, kept through later filters.

    Apply it to a source, before any shuffle.
    """
    return df.withColumns(
        {"source_rank": F.lit(rank), "id": F.monotonically_increasing_id()}
    )


def select_xy(df: DataFrame, text: str = "clean_text", label: str = "label") -> DataFrame:
    return df.select(text, label)
