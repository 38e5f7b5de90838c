"""Text files of two-line records: a line of digits names the record, the next is its value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textprep.functions.classes import SPACE
from textprep.operators.joins import spread_lookup
from textprep.session import pin_small, stable
from textprep.sources.splits import in_file, last_where, runs, split_lines

REPEATED = 1_000_000  # repeated ids that are broadcast; more are looked up by a shuffle


@cache
def _digits() -> str:
    """Class of digit characters: decimal digits plus digit-like ones such as ``²``."""
    other = (chr(i) for i in range(0x110000) if chr(i).isdigit() and not chr(i).isdecimal())
    return r"\p{Nd}" + "".join(other)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _named(lines: DataFrame, carry: tuple[str, ...], last: bool) -> DataFrame:
    """The value lines with the id that stands before them in their split, or null.

    ``number`` counts the lines of the split. With ``last`` one row more for every split: its
    last id under the number -1. Only the columns in ``carry`` go along.
    """
    kinds = {c: lines.schema[c].dataType.simpleString() for c in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, current = None, 0, None
        empty: list = [None] * len(carry)

        def ended() -> pa.RecordBatch:
            row = dict(zip(carry, empty)) | {"path": held}
            arrays = [pa.array([split[0]]), pa.array([split[1]]), pa.array([-1]), pa.array([current], pa.string())]
            arrays += [pa.array([row[c]], pa.string() if kinds[c] == "string" else pa.bool_()) for c in carry]
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "number", "id", *carry])

        held = None
        for batch in batches:
            for own, low, high in runs(batch):
                if own != split:
                    if split is not None and last:
                        yield ended()
                    split, number, current = own, 0, None
                part = batch.slice(low, high - low)
                names = part.column("name")
                is_id = names.is_valid().to_numpy(zero_copy_only=False)
                at = last_where(is_id)
                ids = names.take(pa.array(np.maximum(at, 0), mask=at < 0)).cast(pa.string())
                if current is not None:
                    ids = ids.fill_null(current)
                values = pa.array(~is_id)
                numbers = pa.array(number + np.arange(len(is_id)))
                chosen = [part.column("file"), part.column("block"), numbers, ids, *(part.column(c) for c in carry)]
                yield pa.RecordBatch.from_arrays(
                    [c.filter(values) for c in chosen], ["file", "block", "number", "id", *carry]
                )
                number, current = number + len(is_id), ids[-1].as_py()
                held = part.column("path")[0].as_py() if "path" in carry else None
        if split is not None and last:
            yield ended()

    fields = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return lines.mapInArrow(run, f"file bigint, block bigint, number bigint, id string, {fields}")


def read_id_value_lines(
    spark: SparkSession, path: str | Sequence[str], skip_blank: bool = True
) -> DataFrame:
    """``(id, value)`` with the last value of each id.

    ``skip_blank=False`` lets a blank line overwrite the value before it.

    Lines are read as ordinary splits, twice. First without their text: every value line gets
    the id before it, one row a split carries the last id over to the next splits, and ids that
    come more than once are found with the place of their last value. Then with their text:
    each task names its own lines and drops what is overwritten. Only ids and places cross an
    exchange, as long as the repeated ids are few enough to be broadcast.
    """
    text = _strip(F.col("value"))
    lines = split_lines(spark, path).withColumn("value", text)
    lines = lines.withColumn("name", F.when(F.col("value").rlike(f"^[{_digits()}]+$"), F.col("value")))
    blank = (F.col("value") == "").alias("blank")
    found = stable(_named(lines.select("path", "file", "block", "name", blank), ("path", "blank"), True))
    splits = (
        found.filter("number = -1")
        .withColumn("carried", F.last("id", ignorenulls=True).over(in_file()))
        .withColumn("split", F.row_number().over(Window.orderBy("path", "block")))
        .select("file", "block", "split", "carried")
    )
    splits = F.broadcast(stable(splits))  # one row a split

    def completed(rows: DataFrame) -> DataFrame:
        rows = rows.join(splits, ["file", "block"])
        rows = rows.withColumn("id", F.coalesce("id", "carried")).filter("id is not null")
        return rows.drop("file", "block", "carried")

    values = completed(found.filter("number >= 0"))
    if skip_blank:
        values = values.filter(~F.col("blank"))
    places = values.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("split", "number")).alias("last")
    )
    repeated = stable(places.filter("n > 1"))
    texts = completed(_named(lines.select("file", "block", "name", "value"), ("value",), False))
    if skip_blank:
        texts = texts.filter(F.col("value") != "")
    last = repeated.select("id", "last")
    small = pin_small(last, REPEATED)
    if small is not last:
        texts = texts.join(small, "id", "left")
    else:
        texts = spread_lookup(texts, repeated, "id", ["last"], [F.desc("n")])
    here = F.struct("split", "number")
    return texts.filter(F.col("last").isNull() | (F.col("last") == here)).select("id", "value")
