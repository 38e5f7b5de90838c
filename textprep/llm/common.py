"""What several operators share: shipping the package, writing once, Arrow batches."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

import textprep
from textprep.session import shared_folder


def ship(spark: SparkSession) -> None:
    """Let the executors import this package: one zip a Spark context, by Spark's file server."""
    context = spark.sparkContext
    if getattr(context, "_textprep_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(textprep.__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "textprep")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    place = os.path.join(tempfile.mkdtemp(prefix="textprep-"), "textprep.zip")
    with open(place, "wb") as file:
        file.write(packed.getvalue())
    context.addPyFile(place)
    context._textprep_shipped = True


def write_once(df: DataFrame) -> DataFrame:
    """Compute a frame that is read several times once, into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_A_TASK = 100_000


def write_small(df: DataFrame) -> DataFrame:
    """As :func:`write_once`, for a result of a few numbers a row that may be much smaller than
    what it comes from: it is read by no more tasks than its rows are worth."""
    kept = write_once(df)
    return kept.coalesce(max(1, kept.count() // ROWS_A_TASK))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``make()`` of each task to all Arrow batches of its partition."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


SLICE_ROWS, SLICE_BYTES = 2_000, 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut between rows, into pieces of :data:`SLICE_ROWS` rows and
    :data:`SLICE_BYTES` bytes of text at most, or of one row: what a task makes of a piece is
    bounded, however long the texts of a batch are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            upto = min(max(upto, at + 1), at + SLICE_ROWS)
            yield batch.slice(at, upto - at)
            at = upto
        del batch  # before the next one comes


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


BROADCAST_ROWS = 200_000  # of a few numbers and a key each
SALTS = 64


def attach(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a written table that has one row a key; null is a key too.

    The table is counted: a small one is broadcast. A larger one is repeated under
    :data:`SALTS` salts that the rows take in turn, so a key with a third of all rows is
    spread over as many tasks.
    """
    named = {k: f"_of_{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(named)
    match = [F.col(k).eqNullSafe(F.col(o)) for k, o in named.items()]
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), match, "left").drop(*named.values())
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = rows.withColumn("_salt_of", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt_at", salts)
    match.append(F.col("_salt_of") == F.col("_salt_at"))
    return left.join(right, match, "left").drop(*named.values(), "_salt_of", "_salt_at")
