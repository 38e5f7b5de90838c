"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source asks for a share of the mix by its weight. A source that would be repeated more
than ``max_epochs`` times is clamped there, and what it can't give is asked of the others by
their weights, until none is above. A document is then taken as often as its source is
repeated as a whole; the fractional repetition goes to the documents that come first in a
seeded order of the source, up to the place nearest the target.

That place is found by descending the digits of the order: words are summed by source and
digit, and only the digit in which the target falls is looked into further. So a source of any
size is never sorted, gathered or numbered, and its sums are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprep.llm.common import attach, write_once
from textprep.operators.ranking import global_rank

DIGIT = 12  # bits looked at in one step
DIGITS = 5  # steps through a number of 60 bits


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    words = F.array_remove(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, pattern: tuple[float, ...]) -> DataFrame:
    """``source, weight``: distinct sources by code point, null last, get the pattern in turn."""
    ranked = global_rank(sources.select("source").distinct(), [F.asc_nulls_last("source")], 0)
    weights = F.array(*(F.lit(float(w)) for w in pattern))
    return ranked.select("source", F.get(weights, F.pmod("idx", F.lit(len(pattern))).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size, weight``.

    The targets have ``share`` times all sizes as their sum, or all caps if these are less. Each
    round sums the caps of clamped sources and the weights of the others; a round clamps one
    source more at least or is the last.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (total["size"] or 0)
    level, before = budget / total["weight"] if total["weight"] else 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        now = sources.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if now["n"] == before or not now["weight"]:
            break
        before = now["n"]
        level = (budget - (now["given"] or 0.0)) / now["weight"]
    return sources.select(
        "source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target")
    )


def _places(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, of_key, of_tie``: rows of the source below this pair are its first ones whose
    words come nearest to ``goal``, a half of a document's words or more counting as over.

    ``open`` has one row for each source whose place is not yet known: the digits so far, and
    the words below them.
    """
    state = write_once(
        goals.filter("goal > 0").select("source", "goal", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    )
    rows = attach(rows.filter("size > 0"), state.select("source", "goal"), ["source"]).filter("goal > 0").drop("goal")
    found: list[DataFrame] = []
    for level in range(2 * DIGITS):
        if state.isEmpty():
            break
        column, shift = ("key", "tie")[level // DIGITS], DIGIT * (DIGITS - 1 - level % DIGITS)
        digit = F.shiftright(column, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        cells = rows.groupBy("source", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("key")
        )
        before = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        cells = attach(cells, state, ["source"]).withColumn(
            "low", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0))
        )
        high = F.col("low") + F.col("words")
        below, edge = high <= F.col("goal"), (F.col("low") < F.col("goal")) & (high > F.col("goal"))
        # the one row of an edge is in if its middle is below the goal
        one = F.when(edge & (F.col("rows") == 1), F.col("low") + high < 2 * F.col("goal"))
        passed = F.col("digit") + F.when(below | one, 1).otherwise(0)
        step = write_once(
            cells.groupBy("source", "goal", "prefix")
            .agg(
                F.max(F.when(below | edge, passed)).alias("digit"),
                F.max(F.when(edge & (F.col("rows") > 1), F.col("low"))).alias("base"),
                F.max(F.when(edge, F.col("key"))).alias("key"),
            )
            .withColumn("prefix", F.shiftleft("prefix", DIGIT) + F.coalesce("digit", F.lit(0)))
        )
        bound = F.shiftleft("prefix", shift)
        if column == "key":
            place = (bound.alias("of_key"), F.lit(0).cast("long").alias("of_tie"))
        else:
            place = (F.col("of_key"), bound.alias("of_tie"))
            step = attach(step, keys, ["source"])
        found.append(step.filter("base is null").select("source", *place))
        state = step.filter("base is not null").select("source", "goal", "base", "prefix")
        inside = attach(rows, state.select("source", F.col("prefix").alias("of")), ["source"])
        rows = write_once(inside.filter(F.shiftright(column, shift) == F.col("of")).drop("of"))
        if level == DIGITS - 1:  # one key is left of each source; ties within it follow
            keys = step.select("source", F.col("prefix").alias("of_key"))
            state = state.withColumn("prefix", F.lit(0).cast("long"))
        state = write_once(state)
    places = goals.select("source").limit(0).select("source", F.lit(0).cast("long").alias("of_key"), F.lit(0).cast("long").alias("of_tie"))
    for part in found:
        places = places.unionAll(part)
    return places


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[float, ...],
    share: float,
    max_epochs: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """``row`` (the columns of ``docs`` as one struct), ``size``, ``source_size``, ``target`` and
    ``copies`` of every row.

    ``weights`` are rows ``source, weight`` or a pattern that the sources get in turn, by code
    point and null last. A source without a weight gives nothing; null is a source of its own.
    A null text and one without words have size 0 and no say. Rows are written once with the
    columns given, so select what is needed. Rows of equal id and size are interchangeable:
    how many of them are taken is fixed, by row the place decides. ``size`` is a whole number,
    the words of ``text`` unless given. No rows give no rows; extra
    columns of any name stay inside ``row``.
    """
    measure = word_count(F.col("text")) if size is None else size
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    source = F.col(source_col).cast("string").alias("source")
    sized = docs.select(row, source, F.col(id_col).alias("_id"), measure.alias("size"))
    order = F.concat_ws(
        "|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size").cast("string")
    )
    rows = write_once(
        sized.select(
            "row", "source", "size", F.conv(F.substr(F.md5(order), F.lit(1), F.lit(15)), 16, 10).cast("long").alias("key"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    sources = write_once(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    if not isinstance(weights, DataFrame):
        weights = repeating_weights(sources, weights)
    else:
        weights = weights.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("double").alias("weight"))
    weighed = write_once(attach(sources, weights, ["source"]).fillna(0.0, ["weight"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = water_fill(weighed, share, max_epochs).withColumn("whole", whole)
    filled = write_once(
        filled.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    slim = rows.select("source", "size", "key", "tie")
    plan = write_once(attach(filled, _places(slim, filled), ["source"]))
    first = (F.col("key") < F.col("of_key")) | ((F.col("key") == F.col("of_key")) & (F.col("tie") < F.col("of_tie")))
    extra = F.when(first & (F.col("size") > 0), 1).otherwise(0)
    return attach(rows, plan, ["source"]).select(
        "row", "size", "source_size", "target", (F.col("whole") + extra).cast("int").alias("copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with the columns they came with."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
