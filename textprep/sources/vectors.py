"""Word-vector tables in the text layout: a ``count dim`` line, then ``word v1 .. vd``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_vectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(term, vector array<float>)``.

    With ``header`` a line of two integers in the first block of a file is taken for the
    header; ``header=False`` keeps all lines, for tables of one dimension with numbers as
    words.
    """
    line = F.rtrim(F.col("value"))
    parts = F.split(line, " ")
    rows = spark.read.text(path).filter(line != "")
    if header:
        first = F.col("_metadata.file_block_start") == 0
        rows = rows.filter(~(first & line.rlike(r"^\d+ \d+$")))
    return rows.select(
        F.element_at(parts, 1).alias("term"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vector"),
    )


def one_vector(vectors: DataFrame) -> DataFrame:
    """One vector a word: of several the largest, component by component from the first."""
    return vectors.groupBy("term").agg(F.max("vector").alias("vector"))


def limit_vectors(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """The vectors whose word occurs in ``terms``, one a word."""
    return one_vector(vectors.join(terms.select("term").distinct(), "term", "left_semi"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Write the table; the header is the first part file, so the parts concatenate."""
    header = vectors.agg(
        F.concat_ws(" ", F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).alias("value")
    )
    body = vectors.select(
        F.concat_ws(" ", "term", F.array_join("vector", " ")).alias("value")
    )
    header.coalesce(1).union(body).write.mode("overwrite").text(path)
