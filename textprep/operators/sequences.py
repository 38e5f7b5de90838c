"""Vocabulary, id sequences, padding and the word-vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.scalars import seeded_normal
from textprep.functions.text import _col, let
from textprep.operators.joins import lookup_terms, lookup_vectors, spread_lookup
from textprep.operators.ranking import global_rank, top_n

OOV = 1


def fit_vocabulary(
    df: DataFrame, tokens: str | Column, num_words: int | None = None, oov: bool = False
) -> DataFrame:
    """``(term, idx, tf)``: 1 is the most frequent word, or 2 if 1 stands for unknown words.

    Ids run below ``num_words``; without a cap every word gets one. Equal counts
    rank by term: a distributed set has no first appearance.
    """
    counts = (
        df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    )
    order = [F.desc("tf"), F.asc("term")]
    start = OOV + 1 if oov else 1
    if num_words is None:
        ranked = global_rank(counts, order, start)
    else:
        ranked = top_n(counts, order, max(num_words - start, 0), start)
    return ranked.select("term", F.col("idx").cast("int").alias("idx"), "tf")


def lookup_ids(
    df: DataFrame, tokens: str | Column, vocab: DataFrame, keys: list[str], num_words: int | None
) -> DataFrame:
    """One row per token: keys, position, term and vocabulary id (null if unknown).

    Ids from ``num_words`` on count as unknown. Rows without tokens appear once, with a
    null term.
    """
    exploded = df.select(*keys, F.posexplode_outer(tokens).alias("pos", "term"))
    if num_words is not None:
        vocab = vocab.filter(F.col("idx") < num_words)
    return lookup_terms(exploded, vocab, ["idx"], [F.asc("idx")], num_words)


def word_places(tokens: Column | str) -> Column:
    """``array<struct<term, at>>``: every different word of one token array, and its places."""

    def runs(s: Column) -> Column:
        def starts_run(i: Column) -> Column:
            return (i == 1) | (F.get(s, i - 1)["term"] != F.get(s, i - 2)["term"])

        def entries(starts: Column) -> Column:
            def entry(first: Column, j: Column) -> Column:
                upto = F.coalesce(F.get(starts, j + 1), F.size(s) + 1)
                at = F.transform(F.slice(s, first, upto - first), lambda x: x["at"])
                return F.struct(F.get(s, first - 1)["term"].alias("term"), at.alias("at"))

            return F.transform(starts, entry)

        return let(F.filter(F.sequence(F.lit(1), F.size(s)), starts_run), entries)

    placed = F.transform(_col(tokens), lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return F.when(F.size(placed) > 0, let(F.array_sort(placed), runs))


def encode_words(
    df: DataFrame, tokens: str | Column, vocab: DataFrame, keys: list[str], oov: bool = False
) -> DataFrame:
    """``keys + seq`` by dictionary: for vocabularies of any size.

    A document's different words meet the vocabulary, each with the list of its places, and
    only numbers come back. A word that fills a document crosses the exchange once, and
    frequent words don't cross it at all (:func:`spread_lookup`).
    """
    words = df.select(*keys, F.inline_outer(word_places(tokens)))
    found = spread_lookup(words, vocab.select("term", "idx"), "term", ["idx"], [F.asc("idx")])
    idx = F.coalesce("idx", F.lit(OOV)) if oov else F.col("idx")
    entry = F.when(F.col("at").isNotNull() & idx.isNotNull(), F.struct(idx.alias("idx"), "at"))
    gathered = found.groupBy(*keys).agg(F.collect_list(entry).alias("_found"))
    placed = F.flatten(
        F.transform(
            "_found", lambda w: F.transform(w["at"], lambda p: F.struct(p.alias("at"), w["idx"].alias("idx")))
        )
    )
    return gathered.select(
        *keys, F.transform(F.array_sort(placed), lambda e: e["idx"]).alias("seq")
    )


def encode(
    df: DataFrame,
    tokens: str | Column,
    vocab: DataFrame,
    keys: list[str],
    num_words: int | None = None,
    oov: bool = False,
) -> DataFrame:
    """``keys + seq``: token ids in order. Unknown words become 1 with ``oov``, else vanish.

    One exchange, of one row per document: the ids of a document are collected
    before it, in the task that read the document. Without ``num_words`` the vocabulary may
    have any size, see :func:`encode_words`.
    """
    if num_words is None:
        return encode_words(df, tokens, vocab, keys, oov)
    ids = lookup_ids(df, tokens, vocab, keys, num_words)
    idx = F.coalesce("idx", F.lit(OOV)) if oov else F.col("idx")
    entry = F.when(F.col("term").isNotNull() & idx.isNotNull(), F.struct("pos", idx.alias("idx")))
    return ids.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["idx"]).alias("seq")
    )


def pad(
    seq: Column | str, length: int, padding: str = "pre", truncating: str = "pre"
) -> Column:
    """Exactly ``length`` ids: cut at one end, filled with 0 at one end."""
    s = _col(seq)
    if truncating == "pre":
        cut = F.when(F.size(s) > length, F.slice(s, -length, length)).otherwise(s)
    elif truncating == "post":
        cut = F.slice(s, 1, length)
    else:
        raise ValueError("truncating must be 'pre' or 'post'")
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(s), F.lit(0)))
    if padding == "post":
        return F.concat(cut, zeros)
    if padding == "pre":
        return F.concat(zeros, cut)
    raise ValueError("padding must be 'pre' or 'post'")


def vector_dimension(vectors: DataFrame) -> DataFrame:
    """Smallest and largest vector length; equal if the table is sound."""
    return vectors.agg(
        F.min(F.size("vector")).cast("bigint").alias("min_dim"),
        F.max(F.size("vector")).cast("bigint").alias("max_dim"),
    )


def embedding_table(
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int,
    num_words: int | None = None,
    missing: str = "zeros",
    scale: float = 0.6,
    seed: int = 42,
) -> DataFrame:
    """``(idx, term, vector)`` aligned with the vocabulary ids.

    With ``num_words`` only ids below it. A word without a vector gets zeros, or
    normal values drawn from its own text and the seed.
    """
    if num_words is not None:
        vocab = vocab.filter(F.col("idx") < num_words)
    found = lookup_vectors(vocab.select("idx", "term"), vectors, num_words)
    if missing == "zeros":
        fallback = F.array_repeat(F.lit(0.0).cast("float"), dim)
    elif missing == "normal":
        fallback = seeded_normal("term", dim, scale, seed)
    else:
        raise ValueError("missing must be 'zeros' or 'normal'")
    return found.select("idx", "term", F.coalesce("vector", fallback).alias("vector"))
