"""Duplicates and label conflicts.

Keep-first is an aggregate, never a window: partial aggregation leaves one row per
key and task before the shuffle, so a text held by a third of all rows costs no
more than any other. Each kept column is an aggregate of its own, so Catalyst
drops those that nothing reads, down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.scalars import digest
from textprep.operators.joins import spread_lookup

Order = Column | str | Sequence[str]


def _order(order: Order) -> Column:
    if isinstance(order, Column):
        return order
    return F.col(order) if isinstance(order, str) else F.struct(*order)


def keep_first(df: DataFrame, key: str, order: Order = ("source_rank", "id")) -> DataFrame:
    """One row per value of ``key``: the one that sorts first by ``order``."""
    by = _order(order)
    rest = [F.min_by(c, by).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*rest).select(*df.columns)


def _marked(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with ``_n``: the row count of their key if it is among ``keys``, else null."""
    return spread_lookup(keyed, keys.select("_key", "_n"), "_key", ["_n"], [F.desc("_n")])


def duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """Every row whose ``key`` occurs more than once.

    The repeated keys are found by a pre-aggregated count and joined back by their
    digest; texts themselves are not join keys, and frequent keys are not gathered.
    """
    keyed = df.withColumn("_key", digest(key))
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    return _marked(keyed, repeated).filter("_n is not null").select(*df.columns)


def count_duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """How many rows :func:`duplicate_members` has, without the join."""
    return (
        df.groupBy(digest(key).alias("_key"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )


def conflict_groups(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Key values that carry more than one label, with the number of labels and rows."""
    return (
        df.groupBy(key)
        .agg(
            F.size(F.collect_set(label)).cast("bigint").alias("n_labels"),
            F.count("*").alias("n_rows"),
        )
        .filter("n_labels > 1")
    )


def drop_conflicts(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """All rows but those whose key carries more than one label; repeats stay."""
    keyed = df.withColumn("_key", digest(key))
    conflicts = (
        keyed.groupBy("_key")
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("_n"))
        .filter("lo <> hi")
    )
    return _marked(keyed, conflicts).filter("_n is null").select(*df.columns)


def resolve(
    df: DataFrame, key: str, label: str = "label", order: Order = ("source_rank", "id")
) -> DataFrame:
    """Drop conflicting keys, then keep the first row of each, in one aggregate."""
    by = _order(order)
    rest = [F.min_by(c, by).alias(c) for c in df.columns if c not in (key, label)]
    return (
        df.groupBy(key)
        .agg(F.min(label).alias(label), F.max(label).alias("_hi"), *rest)
        .filter(F.col(label).eqNullSafe(F.col("_hi")))
        .select(*df.columns)
    )


def distinct_terms(df: DataFrame, tokens: str | Column) -> DataFrame:
    """Distinct vocabulary of a token column."""
    return df.select(F.explode(tokens).alias("term")).distinct()
