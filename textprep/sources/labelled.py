"""Labelled text tables: CSV files, inline rows and their union."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textprep.sources.quoted import read_quoted

# Optional columns of a tweet export, none of them used further on.
PROFILE_COLUMNS = (
    "username", "acctdesc", "location", "following", "followers", "totaltweets",
    "usercreatedts", "tweetcreatedts", "retweetcount", "hashtags",
)

# Cell contents that a CSV reader in the pandas tradition takes as missing.
MISSING_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself, or a ``ValueError`` at plan time if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def with_label(df: DataFrame, value: int | str) -> DataFrame:
    return df.withColumn("label", F.lit(value))


def read_tweets(
    spark: SparkSession,
    path: str | Sequence[str],
    multiline: bool = True,
    missing: Sequence[str] = MISSING_VALUES,
    schema: T.StructType | None = None,
) -> DataFrame:
    """CSV with a header row; every column a string unless ``schema`` says otherwise.

    ``multiline`` allows line breaks inside quotes, at the price of reading the lines twice
    (:func:`read_quoted`); pass ``False`` for exports without such breaks. Either way a large
    file is read by many tasks. ``id`` numbers the rows in reading order within this read.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path if isinstance(path, str) else list(path))
    number = F.monotonically_increasing_id()
    if multiline and df.columns:
        # Spark's reader has told the names; it would read each file by one task
        df, number = read_quoted(spark, path, df.schema, schema is not None), F.col("_reading_order")
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    df = df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c)
            if c in strings
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
    if "id" not in df.columns:
        df = df.withColumn("id", number)
    return df.drop("_reading_order")


def union_labelled(sources: Sequence[tuple[DataFrame, int | str]]) -> DataFrame:
    """Union by name, missing columns null; ``label`` and ``source_rank`` per source.

    Rows have no order of their own: "first" means the smallest
    ``(source_rank, id)``, so earlier sources win.
    """
    parts = [
        with_label(df, value).withColumn("source_rank", F.lit(rank))
        for rank, (df, value) in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_labelled(
    spark: SparkSession,
    paths: Mapping[int | str, str | Sequence[str]],
    text: str = "text",
    **options,
) -> DataFrame:
    """One CSV location per class; the first one given ranks first."""
    return union_labelled(
        [
            (require_columns(read_tweets(spark, path, **options), [text]), label)
            for label, path in paths.items()
        ]
    )


def inline_rows(
    spark: SparkSession, rows: Sequence[tuple], schema: str = "text string, label int"
) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
