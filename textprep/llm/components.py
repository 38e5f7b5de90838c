"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textprep.llm.common import write_small


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all ends of ``a, b``; a component is its smallest node.

    Turns the edges into stars: every node passes its smallest neighbour on to its larger
    neighbours, then to its smaller ones, until nothing changes. Minima are aggregated before
    the shuffle, so a node of very many neighbours meets them as one row per task. Loops and
    repeated edges do no harm; a null end drops its edge.
    """
    stars = write_small(
        edges.filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = stars.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sign")
        ).first()
        if state == before:
            break
        before = state
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = write_small(
            small.filter("u != v").unionAll(lower.select("u", F.col("m").alias("v"))).distinct()
        )
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
