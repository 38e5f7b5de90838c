"""Reproducible stratified split, undersampling and folds, exact at any size.

Rows are ordered inside their class by ``md5(seed | id)``. What a split needs is the
key at a few ranks per class, so only these keys are searched for, by counting key
prefixes and then ranking the rows of the one prefix that holds the rank. Assigning
rows is a comparison with the found keys: rows are never shuffled or sorted by class,
and two classes do not mean two tasks. ``id`` must be unique per row.

The input is read three times (twice for ids and labels only); checkpoint it first
if it is expensive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.functions.scalars import seeded_key

MAX_CLASSES = 10_000
ROWS_PER_PREFIX = 250_000


def class_sizes(df: DataFrame, label: str = "label") -> dict:
    """Rows per class as a dictionary, ordered by label; null labels are left out."""
    rows = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"))
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {label!r} has over {MAX_CLASSES} values; not a class label")
    return dict(sorted((r[label], r["n"]) for r in rows))


def largest_remainder(sizes: dict, total: int) -> dict:
    """Spread ``total`` over the classes in proportion; ties go to the smaller label."""
    n = sum(sizes.values())
    quota = {c: m * total // n for c, m in sizes.items()}
    by_rest = sorted(sizes, key=lambda c: (-(sizes[c] * total % n), c))
    for c in by_rest[: total - sum(quota.values())]:
        quota[c] += 1
    return quota


def keys_at_ranks(
    df: DataFrame, label: str, key: Column, ranks: Sequence[tuple], sizes: dict
) -> dict:
    """``{(label, rank): key}`` for 1-based ranks within the class order."""
    ranks = [(c, r) for c, r in ranks if 1 <= r <= sizes[c]]
    if not ranks:
        return {}
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    largest = max(sizes.values())
    digits = max(0, math.ceil(math.log(largest / ROWS_PER_PREFIX, 16)))
    keyed = df.select(F.col(label).alias("c"), key.alias("k")).withColumn(
        "p", F.substring("k", 1, digits) if digits else F.lit("")
    )
    # at most MAX_CLASSES times the ranks asked for
    wanted = F.broadcast(spark.createDataFrame(ranks, f"c {label_type}, r bigint"))
    upto = Window.partitionBy("c").orderBy("p")
    located = (
        keyed.groupBy("c", "p")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .join(wanted, "c")
        .filter("r <= upto and r > upto - n")
        .select("c", "p", "r", (F.col("r") - F.col("upto") + F.col("n")).alias("rest"))
        .collect()
    )
    spots = F.broadcast(
        spark.createDataFrame(located, f"c {label_type}, p string, r bigint, rest bigint")
    )
    inside = Window.partitionBy("c", "p").orderBy("k")
    found = (
        keyed.join(spots.select("c", "p").distinct(), ["c", "p"], "left_semi")
        .withColumn("rest", F.row_number().over(inside).cast("bigint"))
        .join(spots, ["c", "p", "rest"])
        .select("c", "r", "k")
        .collect()
    )
    return {(f["c"], f["r"]): f["k"] for f in found}


def _with_cuts(df: DataFrame, label: str, cuts: dict, kind: str) -> DataFrame:
    """Join the cut keys on: one row per class, built on the driver."""
    label_type = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        list(cuts.items()), f"{label} {label_type}, _cut {kind}"
    )
    return df.join(F.broadcast(table), label, "left").select(*df.columns, "_cut")


def stratified_split(
    df: DataFrame,
    test_fraction: float,
    seed: int,
    label: str = "label",
    row_id: str = "id",
) -> DataFrame:
    """Add ``split`` (``train``/``test``); the test part has ``ceil(n * fraction)`` rows."""
    key = seeded_key(row_id, seed)
    sizes = class_sizes(df, label)
    quota = largest_remainder(sizes, math.ceil(sum(sizes.values()) * test_fraction))
    at = keys_at_ranks(df, label, key, list(quota.items()), sizes)
    cuts = {c: at.get((c, q), "") for c, q in quota.items()}
    in_test = F.coalesce(key <= F.col("_cut"), F.lit(False))
    return (
        _with_cuts(df, label, cuts, "string")
        .withColumn("split", F.when(in_test, "test").otherwise("train"))
        .drop("_cut")
    )


def undersample(
    df: DataFrame, seed: int, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """As many rows of every class as the smallest class has."""
    key = seeded_key(row_id, seed)
    sizes = class_sizes(df, label)
    smallest = min(sizes.values())
    at = keys_at_ranks(df, label, key, [(c, smallest) for c in sizes], sizes)
    cuts = {c: at[c, smallest] for c in sizes}
    return _with_cuts(df, label, cuts, "string").filter(key <= F.col("_cut")).drop("_cut")


def stratified_folds(
    df: DataFrame, folds: int, seed: int, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """Add ``fold`` (0-based); per class the fold sizes differ by one row at most."""
    key = seeded_key(row_id, seed)
    sizes = class_sizes(df, label)
    ends = {
        c: [sum(n // folds + (g < n % folds) for g in range(f + 1)) for f in range(folds - 1)]
        for c, n in sizes.items()
    }
    wanted = sorted({(c, r) for c, rs in ends.items() for r in rs})
    at = keys_at_ranks(df, label, key, wanted, sizes)
    cuts = {c: [at[c, r] for r in rs] for c, rs in ends.items()}
    passed = F.size(F.filter("_cut", lambda cut: key > cut))
    return (
        _with_cuts(df, label, cuts, "array<string>")
        .withColumn("fold", F.when(F.col("_cut").isNotNull(), passed).cast("int"))
        .drop("_cut")
    )
