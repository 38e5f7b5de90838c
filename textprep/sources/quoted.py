"""CSV files with line breaks inside quotes, read by many tasks.

Whether a split starts inside quotes depends on all splits before it. Each split says how it
ends for either start, which is a function of two values on two values, and functions compose:
the last split that forgets its start, and the number of later ones that turn it round, decide.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from textprep.session import stable
from textprep.sources.splits import in_file, runs, split_lines

# a quoted value, with anything up to the next comma taken as part of it; or a plain one
_VALUE = r'(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)'
_ROW = re.compile(rf"(?:{_VALUE},)*+{_VALUE}")
_CLOSE = re.compile(r'(?:[^"]|"")*+"')
OPTIONS = {"escape": '"', "multiLine": "true"}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quote is open after a line that starts inside quotes or at a row's start."""
    at = 0
    if inside:
        closed = _CLOSE.match(line)
        if closed is None:
            return True
        comma = line.find(",", closed.end())
        if comma < 0:
            return False
        at = comma + 1
    return _ROW.fullmatch(line, at) is None


def _ends(values: pa.Array, quoted: np.ndarray, inside: bool) -> np.ndarray:
    """Whether a quote is open after each line; lines without a quote change nothing."""
    after = [inside]
    for line in values.filter(pa.array(quoted)).to_pylist():
        after.append(ends_inside(line, after[-1]))
    return np.array(after)[np.cumsum(quoted)]


def _effects(lines: DataFrame) -> DataFrame:
    """``file, block, out, into, returns``: how each split ends if it starts outside quotes, or
    inside, and whether its first line ends with a carriage return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, returns = None, [False, True], False

        def ended() -> pa.RecordBatch:
            row = [pa.array([x]) for x in (*split, *state, returns)]
            return pa.RecordBatch.from_arrays(row, ["file", "block", "out", "into", "returns"])

        for batch in batches:
            for own, low, high in runs(batch):
                if own != split:
                    if split is not None:
                        yield ended()
                    split, state = own, [False, True]
                    returns = batch.column("value")[low].as_py().endswith("\r")
                part = batch.slice(low, high - low)
                for line in part.column("value").filter(part.column("quoted")).to_pylist():
                    out = ends_inside(line, state[0])
                    state = [out, out if state[0] == state[1] else ends_inside(line, state[1])]
        if split is not None:
            yield ended()

    return lines.mapInArrow(run, "file bigint, block bigint, out boolean, into boolean, returns boolean")


def _starts(effects: DataFrame) -> DataFrame:
    """``file, block, inside, cut, returns``: the state that each split starts with, whether its
    last row goes on in the next one, and whether lines of the file end with a carriage return,
    as its first one does."""
    constant = F.col("out") == F.col("into")
    turns = F.sum(F.when(~constant & F.col("out"), 1).otherwise(0))
    upto = in_file().rowsBetween(Window.unboundedPreceding, 0)
    counted = effects.withColumn("turns", turns.over(upto))
    forgets = F.when(constant, F.struct("out", "turns"))
    counted = counted.withColumn("from", F.last(forgets, ignorenulls=True).over(in_file()))
    before = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    turned = (before - F.coalesce(F.col("from.turns"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("from.out"), F.lit(False)) != turned
    returns = F.max(F.col("returns") & (F.col("block") == 0)).over(Window.partitionBy("file"))
    return counted.withColumn("inside", inside).select(
        "file", "block", "inside", returns.alias("returns"), F.when(F.col("inside"), F.col("into")).otherwise(F.col("out")).alias("cut")
    )


def _records(lines: DataFrame, header: list[str] | None) -> DataFrame:
    """``kind, file, block, id, record``: whole rows (0), what a split has of a row that began
    earlier (1, and 2 if it does not end there either), and the start of a row that goes on (3).

    The first row of a file is its header and left out; it has to agree with ``header``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, open_, begun, first, owed = None, [], None, False, False

        def told(kind: int, own: tuple[int, int], ids: list, records: list) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * n, pa.int32()), pa.array([own[0]] * n, pa.int64()),
                    pa.array([own[1]] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(records, pa.string()),
                ],
                ["kind", "file", "block", "id", "record"],
            )

        def ended() -> pa.RecordBatch:
            rest = "\n".join(open_)
            return told(2 if owed else 3, split, [begun], [rest])

        def is_header(record: str) -> bool:
            nonlocal first
            if not first or not record:
                return False
            first = False
            if header is not None:
                names = next(csv.reader([record]))
                if [n.lower() for n in names] != [h.lower() for h in header]:
                    raise ValueError(f"the header {record!r} is not {header}")
            return True

        for batch in batches:
            for own, low, high in runs(batch):
                part = batch.slice(low, high - low)
                if own != split:
                    if open_:
                        yield ended()
                    split, open_, begun, first = own, [], None, own[1] == 0
                    owed = bool(part.column("inside")[0].as_py())
                    state = owed
                values = part.column("value")
                quoted = part.column("quoted").to_numpy(zero_copy_only=False)
                ends = _ends(values, quoted, state)
                starts = np.concatenate([[state], ends[:-1]])
                state = bool(ends[-1])
                ids = part.column("id")
                whole = ~starts & ~ends
                if first:
                    for i in np.flatnonzero(whole).tolist():
                        if (starts[:i] | ends[:i]).any():
                            break  # the header has several lines
                        record = values[i].as_py()
                        if is_header(record):
                            whole[i] = False
                            break
                n = int(whole.sum())
                if n:
                    keep = pa.array(whole)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.zeros(n, np.int32)), part.column("file").filter(keep),
                            part.column("block").filter(keep), ids.filter(keep), values.filter(keep),
                        ],
                        ["kind", "file", "block", "id", "record"],
                    )
                for i in np.flatnonzero(starts | ends).tolist():
                    if not starts[i]:
                        begun = ids[i].as_py()
                    open_.append(values[i].as_py())
                    if ends[i]:
                        continue
                    record = "\n".join(open_)
                    if owed:
                        yield told(1, own, [None], [record])
                    elif not is_header(record):
                        yield told(0, own, [begun], [record])
                    open_, begun, owed = [], None, False
        if open_:
            yield ended()

    return lines.mapInArrow(run, "kind int, file bigint, block bigint, id bigint, record string")


def _joined(pieces: DataFrame) -> DataFrame:
    """``id, record`` of rows that several splits hold pieces of."""
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == 3)
    begun = F.last("id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("id", begun).filter("id is not null")
    gathered = F.array_sort(F.collect_list(F.struct("block", (F.col("kind") != 3).alias("later"), "record")))
    return pieces.groupBy("file", "id").agg(
        F.array_join(F.transform(gathered, lambda p: p["record"]), "\n").alias("record")
    ).select("id", "record")


def read_quoted(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, check_header: bool = False
) -> DataFrame:
    """The columns of ``schema`` and ``_reading_order``, which numbers the rows in reading order.

    Equal to Spark's CSV reader with a header and ``multiLine``, but every file is read by as
    many tasks as it has splits. Lines are read twice, and a third time if a row crosses the
    edge of a split. Lines end with a line feed, all lines of a file with or without
    a carriage return before it, which goes. Pieces of
    rows at the edges, two a split at most, are joined by file. A quote that is never closed
    takes in the rest of its file, less the last line feed.
    """
    value = F.col("value")
    lines = split_lines(spark, path, "\n").select(
        "file", "block", "value", F.contains(value, F.lit('"')).alias("quoted")
    )
    starts = stable(_starts(_effects(lines)))
    edges = not starts.filter("inside or cut").isEmpty()
    named = lines.withColumn("id", F.monotonically_increasing_id()).join(
        F.broadcast(starts.select("file", "block", "inside", "returns")), ["file", "block"]
    )
    bare = F.when(F.col("returns"), F.regexp_replace(value, "\r$", "")).otherwise(value)
    named = named.withColumn("value", bare)
    header = [f.name for f in schema] if check_header else None
    records = _records(named.select("file", "block", "value", "quoted", "id", "inside"), header)
    rows = records.filter("kind = 0").select("id", "record")
    if edges:
        rows = rows.unionAll(_joined(records.filter("kind > 0")))
    record = F.col("record")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv(record, fields, OPTIONS).alias("row")
    return rows.filter(record != "").select(F.col("id").alias("_reading_order"), parsed).select("row.*", "_reading_order")
