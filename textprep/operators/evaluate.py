"""Evaluation of predictions as tables.

Every report starts from one count per (label, prediction) pair, the only step that
touches the predictions; all figures follow from those few rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

MAX_CLASSES = 5_000


def _ratio(a: Column, b: Column) -> Column:
    """0/0 counts as 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_cells(
    df: DataFrame, label: str = "label", prediction: str = "prediction", n: str | None = None
) -> DataFrame:
    """``(label, prediction, n)`` for every pair of known classes, zeros included.

    ``n`` names a column that already counts equal rows. More than ``MAX_CLASSES`` classes
    end the job: the cells are their square.
    """
    count = F.count("*") if n is None else F.sum(n)
    kind = df.schema[label].dataType
    cells = df.groupBy(
        F.col(label).alias("label"), F.col(prediction).cast(kind).alias("prediction")
    ).agg(count.alias("n"))
    both = F.array_compact(
        F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("prediction")))
    )
    # the known classes, one row of bounded size
    known = cells.agg(both.alias("known")).select(
        F.when(F.size("known") <= MAX_CLASSES, F.col("known"))
        .otherwise(F.raise_error(F.lit(f"more than {MAX_CLASSES} classes")))
        .alias("known")
    )
    grid = known.withColumn("label", F.explode("known")).select(
        "label", F.explode("known").alias("prediction")
    )
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix(
    df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per true class, one column per predicted class.

    A prediction outside ``classes`` ends the job instead of getting lost.
    """
    cells = confusion_cells(df, label, prediction)
    outside = F.concat(F.lit("no column for the predicted class "), F.col("prediction").cast("string"))
    lost = ~F.col("prediction").isin(classes) & (F.col("n") > 0)
    return (
        cells.withColumn("n", F.when(lost, F.raise_error(outside)).otherwise(F.col("n")))
        .groupBy("label")
        .pivot("prediction", classes)
        .agg(F.sum("n"))
        .na.fill(0)
        .orderBy("label")
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """``(label, tp, predicted, support, precision, recall, f1)`` per class."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("label"), hit.cast("bigint").alias("tp"),
            zero.alias("predicted"), F.col("n").alias("support"),
        ),
        F.struct(
            F.col("prediction").alias("label"), zero.alias("tp"),
            F.col("n").alias("predicted"), zero.alias("support"),
        ),
    )
    sums = (
        cells.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return sums.select(
        "label", "tp", "predicted", "support",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, predicted + support).alias("f1"),
    )


def averages(metrics: DataFrame) -> DataFrame:
    """The rows ``accuracy``, ``macro avg`` and ``weighted avg`` of a report."""
    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    sums = metrics.agg(
        support.alias("support"),
        _ratio(F.sum("tp"), support).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
          for m in measures],
    )

    def row(name: str, *values: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(m) for m, v in zip(measures, values)],
            F.col("support"),
        )

    none = F.lit(None).cast("double")
    return sums.select(
        F.inline(
            F.array(
                row("accuracy", none, none, F.col("accuracy")),
                row("macro avg", *[F.col(f"macro_{m}") for m in measures]),
                row("weighted avg", *[F.col(f"weighted_{m}") for m in measures]),
            )
        )
    )


def named(label: str, names: Mapping | None) -> Column:
    """Display name of a class, the label itself where none is given."""
    text = F.col(label).cast("string")
    if not names:
        return text
    pairs = [F.lit(v) for k, name in names.items() for v in (str(k), name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), text), text)


def classification_report(cells: DataFrame, names: Mapping | None = None) -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class, then accuracy and averages."""
    metrics = class_metrics(cells)
    per_class = metrics.select(
        named("label", names).alias("class"), "precision", "recall", "f1", "support"
    )
    return per_class.unionByName(averages(metrics))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(_accuracy(label, prediction).alias("accuracy"))


def accuracy_by_split(
    df: DataFrame, split: str = "split", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return df.groupBy(split).agg(_accuracy(label, prediction).alias("accuracy"))


def _accuracy(label: str, prediction: str) -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def balanced_accuracy(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Mean recall over the classes that occur."""
    recall = df.groupBy(label).agg(_accuracy(label, prediction).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))


def positive_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int | str = 1
) -> DataFrame:
    """Precision and recall of one class in a single pass."""
    actual, said = F.col(label) == positive, F.col(prediction) == positive
    tp = F.count_if(actual & said)
    return df.agg(
        _ratio(tp, F.count_if(said)).alias("precision"),
        _ratio(tp, F.count_if(actual)).alias("recall"),
    )
