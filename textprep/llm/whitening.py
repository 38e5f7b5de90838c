"""Whitening of vectors: distributed exact covariance, refined eigenvectors, projection.

Components are integers, so sums and the centred products are exact, whatever the order of
tasks; rounding begins with the covariance itself. Vectors are centred by the whole part of
their mean before multiplying, and the fraction that is left is settled in exact arithmetic.
What reaches the driver has the size of one matrix of the vector's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textprep.llm.common import ship
from textprep.llm.eigen import eigen
from textprep.llm.vectors import scaled, sound_rows

LIMIT = 1 << 40  # of an integer component
EXACT = 1 << 53  # whole numbers up to here are exact in double precision
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """``mean`` is ``sums / n``; ``vectors`` are the components as columns, in double precision."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What the sums of vectors centred by :attr:`whole` come to."""
        return [s % self.n for s in self.sums]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; not a number where a component has no variance."""
        centred = (x - self.whole) - np.array([r / self.n for r in self.rest])
        with np.errstate(invalid="ignore", divide="ignore"):
            return (centred @ self.vectors) / np.where(self.values > 0, np.sqrt(np.abs(self.values)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n * x - sums) ** 2``, exact; None if it needs more than 63 bits."""
        centred = x - self.whole
        largest = int(np.abs(centred).max(initial=0)) + 1
        if x.shape[1] * (self.n * largest) ** 2 < 1 << 62:
            gaps = self.n * centred - np.array(self.rest, np.int64)
            return np.einsum("pd,pd->p", gaps, gaps).tolist()
        out: list[int | None] = []
        for row in centred.tolist():
            total = sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest))
            out.append(total if total < 1 << 63 else None)
        return out


def products(centred: np.ndarray) -> np.ndarray:
    """Exact ``centred.T @ centred`` as Python integers.

    Blocks of rows are so small that every sum in them is exact in double precision, and fast.
    """
    total = np.zeros((centred.shape[1],) * 2, object)
    largest = int(np.abs(centred).max(initial=0))
    step = min(BLOCK, EXACT // max(1, largest * largest))
    if not step:
        wide = centred.astype(object)
        return total + wide.T @ wide
    for start in range(0, len(centred), step):
        block = centred[start : start + step].astype(np.float64)
        total = total + (block.T @ block).astype(np.int64).astype(object)
    return total


def _matrices(batches: Iterator[pa.RecordBatch], size: int, factor: int, add: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield scaled(batch.slice(start, BLOCK).column("vector"), size, factor, LIMIT) + add


def _whole_numbers(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _summed(rows: DataFrame, size: int, factor: int, add: int) -> tuple[int, list[int]]:
    """Rows, and the sum of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for x in _matrices(batches, size, factor, add):
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, size), pa.int32()), _whole_numbers([n, *total.tolist()])], ["i", "v"]
        )

    found = rows.mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    at = {r["i"]: int(r["v"]) for r in found.collect()}
    return at.get(-1, 0), [at.get(i, 0) for i in range(size)]


def _covariance(rows: DataFrame, size: int, factor: int, add: int, n: int, sums: list[int]) -> np.ndarray:
    """Exact products of centred vectors, divided once; extended precision."""
    whole = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for x in _matrices(batches, size, factor, add):
            total = total + products(x - whole)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                _whole_numbers(total[upper].tolist()),
            ],
            ["i", "j", "v"],
        )

    found = rows.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    rest = [s % n for s in sums]
    out = np.zeros((size, size), np.longdouble)
    for r in found.collect():  # half a matrix of the vector's length
        i, j = r["i"], r["j"]
        # the mean of products of the fractions goes, in whole numbers
        exact = n * int(r["v"]) - rest[i] * rest[j]
        quotient, left = divmod(exact, n * n)
        out[i, j] = out[j, i] = np.longdouble(quotient) + np.longdouble(left) / np.longdouble(n * n)
    return out


def fit(rows: DataFrame, size: int, components: int, factor: int, add: int) -> Whitening:
    """``rows`` has the sound vectors in ``vector``; there is one at least."""
    ship(rows.sparkSession)
    vectors = rows.select("vector")
    n, sums = _summed(vectors, size, factor, add)
    covariance = _covariance(vectors, size, factor, add, n, sums)
    values, columns = eigen(covariance)
    # below the rounding of the matrix a value says nothing
    values = np.where(values > values[0] * size * np.finfo(np.longdouble).eps * 8, values, 0)
    return Whitening(
        n, tuple(sums), values[:components].astype(np.float64),
        np.ascontiguousarray(columns[:, :components].astype(np.float64)), float(np.trace(covariance)),
    )


def identity_error(rows: DataFrame, model: Whitening, size: int, factor: int, add: int) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, over components
    with variance; measured on all rows. Whitened vectors are centred already."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    some = np.flatnonzero(model.values > 0)
    if not len(some):
        return 0.0
    at = np.triu_indices(len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((len(some), len(some))), np.zeros(len(some))
        for x in _matrices(batches, size, factor, add):
            w = shared.value.project(x)[:, some]
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        i = np.concatenate([at[0], np.arange(len(some))])
        j = np.concatenate([at[1], np.full(len(some), -1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.concatenate([total[at], mean]))],
            ["i", "j", "v"],
        )

    found = rows.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    cell = {(r["i"], r["j"]): r["v"] / model.n for r in found.collect()}
    return max(
        abs(v - cell[i, -1] * cell[j, -1] - (i == j)) for (i, j), v in cell.items() if j >= 0
    )


def whiten(
    rows: DataFrame,
    components: int = 8,
    factor: int = 1024,
    add: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for every sound
    vector and component, numbered from 1.

    Rows whose vector is null, empty, or null or not finite somewhere are dropped, and so are
    those of another length than most have. Components become ``floor(factor * c) + add``, the
    first part clipped to :data:`LIMIT`. Vectors shorter than ``components`` have as many
    components as places. A component without variance has a null ``whitened``, 0 explained, and no
    part in ``identity_error``; which of equal eigenvalues comes first is open. ``deviation`` is
    null where it doesn't fit. Repeated rows count each; null ids stay. No sound rows give no
    rows. Other columns are not read.
    """
    kept, size = sound_rows(rows, vector_col)
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    kept = kept.select(F.col(id_col).alias("id"), vector)
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return kept.sparkSession.createDataFrame([], schema)
    model = fit(kept, size, components, factor, add)
    off = identity_error(kept, model, size, factor, add)
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        width = len(now.values)
        shares = now.values / now.trace if now.trace else now.values
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(start, BLOCK)
                x = scaled(cut.column("vector"), size, factor, LIMIT) + add
                many = cut.num_rows * width
                white = now.project(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column("id").take(pa.array(np.repeat(np.arange(cut.num_rows), width))),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), cut.num_rows)),
                        pa.array(np.full(many, now.n)),
                        pa.array(now.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(cut.num_rows), width))),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(shares, cut.num_rows)),
                        pa.array(np.full(many, off)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(run, schema)
