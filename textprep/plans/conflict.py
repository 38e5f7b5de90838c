"""Conflict-aware preparation: texts with contradicting labels are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textprep.functions.cleaners import word_basic
from textprep.functions.scalars import as_text, digest
from textprep.operators.dedup import Order, resolve
from textprep.operators.joins import join_labels
from textprep.operators.profile import class_shares
from textprep.operators.rows import drop_if_present, drop_null, min_length
from textprep.sources.labelled import PROFILE_COLUMNS


def _clean(df: DataFrame, marks: str, min_chars: int | None) -> DataFrame:
    rows = drop_null(drop_if_present(df, PROFILE_COLUMNS))
    rows = rows.withColumn("clean_text", word_basic(as_text("text"), marks=marks)).drop("text")
    return rows if min_chars is None else min_length(rows, length=min_chars)


def prepare(
    df: DataFrame,
    marks: str = "keep",
    min_chars: int | None = None,
    order: Order = ("source_rank", "id"),
) -> DataFrame:
    """Drop unused columns and nulls, clean, remove conflicts, keep the first of the rest."""
    return resolve(_clean(df, marks, min_chars), "clean_text", order=order)


def class_profile(
    texts: DataFrame,
    labels: DataFrame | None = None,
    marks: str = "keep",
    min_chars: int | None = None,
) -> DataFrame:
    """Class shares after preparation.

    No text is needed behind the cleaning, so each is reduced to its digest in the
    scan. ``labels`` (``id``, ``label``) joins after that: neither this join nor the
    aggregate moves a text.
    """
    keyed = _clean(texts, marks, min_chars).withColumn("key", digest("clean_text"))
    if labels is not None:
        keyed = join_labels(keyed.select("id", "key"), labels)
    return class_shares(resolve(keyed.select("key", "label"), "key"))
