"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan sees counts of lengths only (at most one per token of capacity), so its size and
time do not depend on the number of documents. Every piece then takes the slot that the plan
holds for its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textprep.llm.byte_bpe import byte_bpe
from textprep.llm.common import map_batches, parallelism, text_or_empty, write_once

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A document of at most ``capacity`` ids is one piece. A longer one is cut into pieces of
    ``capacity`` ids, of which the first may be shorter. A null text is an empty one: it
    holds ``end_id`` alone (no piece without ``end_id``). Null ids stay null; repeated rows
    give repeated pieces; further columns are not read.
    """

    def make():
        encoder = byte_bpe(tokenizer_path)
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            kept: list[bytes] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.pack(text) + tail
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start - 1) % capacity + 1 if piece == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (key, piece, start, length, zlib.crc32(part))):
                        column.append(value)
                    if keep_ids:
                        kept.append(part)
                    start, piece = start + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        return step

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    return map_batches(source, make, PIECES + (", ids binary" if keep_ids else ""))


def best_fit_plan(
    counts: dict[int, int], capacity: int
) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, rank_from, rank_to, first_sequence, offset)``; ``rank_to`` excluded.

    Longest first, each length goes into the sequences with the least room that still holds
    it, all sequences of equal room at once; what fits nowhere opens new sequences.
    """
    rooms: list[int] = []  # sorted; open[room] lists runs (first sequence, how many)
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots = []
    sequences = 0

    def put_back(room: int, first: int, many: int) -> None:
        if room and many:
            if not open_runs[room]:
                insort(rooms, room)
            open_runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            each = room // length
            full = min(many, left // each)
            rest = min(left - full * each, each) if full < many else 0
            for use, start, run in ((each, first, full), (rest, first + full, 1 if rest else 0)):
                for k in range(use if run else 0):
                    slots.append((length, rank, rank + run, start, capacity - room + k * length))
                    rank += run
                    left -= run
                put_back(room - use * length, start, run)
            untouched = full + (1 if rest else 0)
            put_back(room, first + untouched, many - untouched)
    return slots


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) plus ``sequence_id, offset``.

    The places of a sequence are gapless from 0. Ranks within a length are counted per
    salt first, which rows take in turn, so a length that most pieces share is spread over
    all tasks, and so are pieces equal in ``order``: these take different slots; null keys are
    keys like others. Columns named like the two new ones give way to them. No rows give no
    rows.
    """
    spark = pieces.sparkSession
    # equal plans for equal inputs: twice read, hence written once
    # whole rows as one column, so that no name of theirs can clash
    row = F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row")
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(max(8, parallelism(spark))))
    salted = write_once(pieces.select(row, F.col("length").alias("length"), turn.alias("_salt")))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = cells.select(
        "length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        best_fit_plan(counts, capacity),
        "length long, rank_from long, rank_to long, first_sequence long, offset long",
    )
    within = Window.partitionBy("length", "_salt").orderBy(*(f"row.{c}" for c in order))
    ranked = (
        salted.withColumn("_row", F.row_number().over(within))
        .join(offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    )
    # the plan's size is bounded by the capacity, whatever the number of documents
    taken = (
        (ranked["length"] == slots["length"])
        & (F.col("_rank") >= F.col("rank_from"))
        & (F.col("_rank") < F.col("rank_to"))
    )
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return ranked.join(F.broadcast(slots), taken).select(
        *(F.col("row").getField(c).alias(c) for c in kept),
        (F.col("first_sequence") + F.col("_rank") - F.col("rank_from")).alias("sequence_id"),
        F.col("offset"),
    )
