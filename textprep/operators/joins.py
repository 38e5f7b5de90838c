"""Lookups between texts, labels, vocabulary and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep.session import pin_small


def join_labels(texts: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Texts with a label; unmatched rows of either side go."""
    return texts.join(labels, key, "inner")


HOT_KEYS = 1_000


def spread_lookup(
    rows: DataFrame, table: DataFrame, key: str, values: list[str], hottest: list[Column]
) -> DataFrame:
    """Left join on ``key`` with a table of any size whose keys are unique.

    A frequent key would send all its rows to one task. The :data:`HOT_KEYS` keys that
    come first by ``hottest`` are broadcast and settle their rows at once; these rows
    then pass the shuffle of the second join under a key of their own, spread evenly, as
    do rows without a key.
    No key beyond the hot ones can hold more than ``1 / HOT_KEYS`` of the rows counted.
    """
    kind = rows.schema[key].dataType
    hot = table.orderBy(*hottest).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(key, F.struct(*values).alias("_hot")))
    cold = table.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    own = F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string")).cast(kind)
    open_key = F.col("_hot").isNull() & F.col(key).isNotNull()
    probe = F.when(open_key, F.col(key)).otherwise(own)
    found = rows.join(hot, key, "left").withColumn("_key", probe).join(cold, "_key", "left")
    both = F.coalesce("_hot", "_cold")
    return found.select(*rows.columns, *[both[v].alias(v) for v in values])


def lookup_terms(
    rows: DataFrame, vocab: DataFrame, values: list[str], hottest: list[Column], size: int | None
) -> DataFrame:
    """Left join on ``term``: by broadcast if the vocabulary has no more than ``size`` rows.

    The size is checked, not assumed; a larger vocabulary goes through the shuffle.
    """
    if size is not None:
        table = vocab.select("term", *values)
        small = pin_small(table, size)
        if small is not table:
            return rows.join(small, "term", "left")
    return spread_lookup(rows, vocab, "term", values, hottest)


def lookup_vectors(
    vocab: DataFrame, vectors: DataFrame, size: int | None = None
) -> DataFrame:
    """Every vocabulary row with its vector, or null.

    A vocabulary of no more than ``size`` rows first picks its vectors out of the table
    without shuffling that table; the left join then has two small sides. A word that the
    table holds several times gets one vector, so rows and ids stay aligned.
    """
    vectors = vectors.select("term", "vector")
    if size is not None:
        vocab = pin_small(vocab, size)
        vectors = vectors.join(vocab.select("term"), "term", "left_semi")
    single = vectors.groupBy("term").agg(F.max("vector").alias("vector"))
    return vocab.join(single, "term", "left")
