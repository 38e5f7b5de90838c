"""Class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textprep.session import pin_small

MAX_CLASSES = 10_000


def balanced_weights(df: DataFrame, label: str = "label", factor: float = 1.0) -> DataFrame:
    """``n / (classes * n_class)`` per class, times ``factor``."""
    everything = Window.partitionBy()
    weight = (
        F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    ) * F.lit(float(factor))
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", weight)


def ratio_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """1 for class 0 and ``n_0 / n_1`` for class 1."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias(label), F.lit(1.0).alias("weight")),
                F.struct(
                    F.lit(1).alias(label), F.try_divide("n0", "n1").alias("weight")
                ),
            )
        )
    )


def attach_weights(
    df: DataFrame, weights: DataFrame, label: str = "label", column: str = "weight"
) -> DataFrame:
    """The rows with their class weight; the class table is broadcast once its size is known."""
    table = pin_small(weights.select(label, F.col("weight").alias(column)), MAX_CLASSES)
    return df.join(table, label, "inner")
