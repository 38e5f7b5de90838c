"""Compression of vectors to one code a part: Lloyd rounds over partition-local cover trees.

Vectors become integers, so sums and distances are exact and don't depend on how rows lie. A
task cuts its rows into chunks and builds a cover tree of each part of a chunk; the chunks are
written once. In every round a task walks its trees with the codebook and adds up what each
entry gets: whole subtrees by their cumulative sums where the triangle inequality settles them,
single points elsewhere. One row an entry and task is all that a round shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textprep.llm import cover_tree
from textprep.llm.common import attach, ship, write_once
from textprep.llm.vectors import scaled, sound_rows

CHUNK = 2048  # vectors that share trees
LIMIT = 1 << 27  # of an integer component: squares of a part's gaps and sums fit in 64 bits


def _chunks(rows: DataFrame, size: int, parts: int, factor: int) -> DataFrame:
    """``ids, labels, x, trees``: a chunk of vectors a row."""
    ship(rows.sparkSession)
    width = size // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                cut = batch.slice(start, CHUNK)
                x = scaled(cut.column("vector"), size, factor, LIMIT)
                trees = []
                for part in range(parts):
                    order, nodes = cover_tree.build(x[:, part * width : (part + 1) * width])
                    trees += [order.tobytes(), nodes.tobytes()]
                one = pa.array([0, cut.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(one, cut.column("id")),
                        pa.ListArray.from_arrays(one, cut.column("label")),
                        pa.array([x.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([trees], pa.list_(pa.binary())),
                    ],
                    ["ids", "labels", "x", "trees"],
                )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary, trees array<binary>"
    return rows.mapInArrow(run, schema)


def _parts(x: bytes, trees: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points, order and nodes of every part of a chunk."""
    whole = np.frombuffer(x, np.int32).reshape(-1, size).astype(np.int64)
    width = size // (len(trees) // 2)
    for part in range(len(trees) // 2):
        order = np.frombuffer(trees[2 * part], np.int32)
        nodes = np.frombuffer(trees[2 * part + 1], cover_tree.NODE)
        yield whole[:, part * width : (part + 1) * width], order, nodes


def _round(chunks: DataFrame, size: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; ``books`` is parts by entries by width."""
    parts, count, width = books.shape
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(books)
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        n, total = np.zeros((parts, count), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for x, trees in zip(batch.column("x").to_pylist(), batch.column("trees").to_pylist()):
                for part, (points, order, nodes) in enumerate(_parts(x, trees, size)):
                    counts, added = cover_tree.sums(points, order, nodes, now[part])
                    n[part] += counts
                    total[part] += added
        used = np.nonzero(n)
        flat = total[used]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used[0].astype(np.int32)), pa.array(used[1].astype(np.int32)), pa.array(n[used]),
                *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(width)),
            ],
            ["part", "entry", "n", *names],
        )

    schema = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names)
    summed = (
        chunks.select("x", "trees")
        .mapInArrow(run, schema)
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    )
    after = books.copy()
    for row in summed.collect():  # parts x entries rows at most
        after[row["part"], row["entry"]] = [row[c] // row["n"] for c in names]
    return after


def _coded(chunks: DataFrame, size: int, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every vector."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(books)
    kinds = {c: chunks.schema[f"{c}s"].dataType.elementType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                cut = batch.slice(at, 1)
                x, trees = cut.column("x")[0].as_py(), cut.column("trees")[0].as_py()
                codes, error = [], 0
                for part, (points, order, nodes) in enumerate(_parts(x, trees, size)):
                    own = cover_tree.entries(points, order, nodes, now[part])
                    gaps = points - now[part][own]
                    codes.append(own.astype(np.uint8))
                    error = error + np.einsum("pd,pd->p", gaps, gaps)
                text = np.stack(codes, axis=1).tobytes().hex()
                each = 2 * len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column("ids").flatten(), cut.column("labels").flatten(),
                        pa.array([text[i : i + each] for i in range(0, len(text), each)], pa.string()),
                        pa.array(error),
                    ],
                    ["id", "label", "code", "error"],
                )

    return chunks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(
    rows: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    factor: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error, label_error`` of every sound row, and the codebooks.

    Rows whose vector is null, empty, or null or not finite somewhere are dropped, and so are
    those of another length than most have. Components are ``floor(factor * x)``, clipped to
    :data:`LIMIT`. The length has to be a multiple of ``parts``, else a ``ValueError``. Entries start as the vectors of the
    smallest ids (null last; of one id the smaller vectors first), fewer than ``entries`` if
    there are fewer rows; 256 at most. Repeated rows are rows of their own; a null label is one label. No sound
    rows give no rows. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two digits has 1 to 256 entries")
    kept, size = sound_rows(rows, vector_col)
    if size % parts:
        raise ValueError(f"{size} components do not make {parts} equal parts")
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    kept = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector)
    start = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").toArrow()
    if not start.num_rows:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumn("label_error", F.col("error")).limit(0), np.zeros((parts, 0, 0), np.int64)
    first = scaled(start.column("vector").combine_chunks(), size, factor, LIMIT)
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    chunks = write_once(_chunks(kept, size, parts, factor))
    for _ in range(rounds):
        books = _round(chunks, size, books)
    coded = write_once(_coded(chunks, size, books))
    errors = write_once(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return attach(coded, errors, ["label"]), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
