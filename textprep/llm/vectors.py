"""Vector columns: which rows are sound, their common length, whole batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """Not null, and neither null nor infinite nor NaN anywhere."""
    sound = F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    )
    return vector.isNotNull() & sound


def sound_rows(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows whose vector is finite, and the length that most of them have (ties: the
    larger); rows of another length go. 0 without rows."""
    vector = F.col(vector_col)
    kept = rows.filter(finite(vector) & (F.size(vector) > 0))
    sizes = kept.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return kept.filter(F.size(vector) == size), size


def scaled(column: pa.Array, size: int, factor: int, limit: int) -> np.ndarray:
    """``floor(factor * x)`` of every component, clipped to ``limit``, one row a vector."""
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(flat * factor), -limit, limit).astype(np.int64)
    return whole.reshape(-1, size)
