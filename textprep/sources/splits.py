"""Text files whose lines have to be read in order, although many tasks read one file.

A file is cut into splits that tasks read apart. What a task can't know is the state that the
lines before its split leave behind: which record is current, whether a quote is open. So a
first pass reduces every split to one row about its effect on that state, a window over these
rows gives each split the state it starts with, and a second pass reads the lines with it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PLACE = ("file", "block")


def split_lines(spark: SparkSession, path: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """``path, file, block, value``: lines in the order of their split; ``file`` is a number."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    name = F.col("_metadata.file_path")
    return reader.text(path if isinstance(path, str) else list(path)).select(
        name.alias("path"), F.xxhash64(name).alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )


def in_file() -> Window:
    """The splits of a file before the current one."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def runs(batch: pa.RecordBatch) -> list[tuple[tuple[int, int], int, int]]:
    """``(file, block), from, to`` of the rows of each split in a batch."""
    file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE)
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    ends = [0, *cuts.tolist(), len(file)]
    return [((int(file[a]), int(block[a])), a, b) for a, b in zip(ends, ends[1:]) if b > a]


def last_where(mask: np.ndarray) -> np.ndarray:
    """For every place the last one up to it where ``mask`` holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
