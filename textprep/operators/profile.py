"""Class profile: counts, shares and the figures derived from them.

Everything starts from one pre-aggregated count per class; windows run over that
small result only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


MAX_LABEL = 1_000_000


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return _counts(df, label).orderBy(F.desc("n"), label)


def class_shares(df: DataFrame, label: str = "label") -> DataFrame:
    counts = _counts(df, label)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), label)


def dense_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Count per integer label from 0 to the largest, zeros included.

    A label over ``MAX_LABEL`` ends the job: the result has a row for each number below it.
    """
    counts = _counts(df, label)
    top = F.when(F.col("top") <= MAX_LABEL, F.col("top")).otherwise(
        F.raise_error(F.lit(f"a label is over {MAX_LABEL}"))
    )
    slots = counts.agg(F.max(label).alias("top")).filter("top is not null").select(
        F.explode(F.sequence(F.lit(0), top.cast("int"))).alias(label)
    )
    return slots.join(counts, label, "left").select(
        label, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def positive_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Mean of the label, plain and as a percentage text."""
    return df.agg(F.avg(label).alias("ratio")).withColumn(
        "percent", F.concat(F.format_number(F.col("ratio") * 100, 2), F.lit("%"))
    )


def distinct_per_group(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(column).alias("n_distinct"))


def min_class_size(df: DataFrame, label: str = "label") -> DataFrame:
    return _counts(df, label).agg(F.min("n").alias("n"))


def count_class(df: DataFrame, value: int | str, label: str = "label") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == value).alias("n"))


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct().orderBy(label)
