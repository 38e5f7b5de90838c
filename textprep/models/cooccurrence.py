"""Word vectors from co-occurrence: counts, positive pointwise mutual information, projection.

Nothing of the size of vocabulary times dimensions exists in one place: counts are aggregated
over all tasks, every word has a random direction that any task can draw again from the seed,
and a word's vector is the sum of its neighbours' directions, weighed by how much more often
they meet than by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.text import _col
from textprep.operators.sequences import fit_vocabulary
from textprep.session import stable


STEP = 250_000  # words whose pairs a task lists at once
PAIRS = 4_000_000  # counts that a task holds: 64 MB


def pair_counts(
    df: DataFrame, tokens: Column | str, terms: list[str], window: int
) -> DataFrame:
    """``(w, c, n)``: how often two words of ``terms``, by their place in it, stand at most
    ``window`` known words apart; once for both ways round, ``w <= c``, see :func:`both_ways`.
    Partial counts leave a task whenever there are :data:`PAIRS` of them."""
    shared = df.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def added(held: tuple, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by sorted key, with others added."""
        at = np.searchsorted(held[0], key)
        there = np.zeros(len(key), bool)
        inside = at < len(held[0])
        there[inside] = held[0][at[inside]] == key[inside]
        held[1][at[there]] += n[there]
        return np.insert(held[0], at[~there], key[~there]), np.insert(held[1], at[~there], n[~there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = shared.value, len(shared.value)
        held = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)],
                ["w", "c", "n"],
            )

        for batch in batches:
            lists = batch.column("tokens")
            at = pc.index_in(pc.list_flatten(lists).cast(pa.string()), value_set=known)
            hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
            ids = pc.drop_null(at).to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit]
            for k in range(0, len(ids), STEP):
                # the window of a slice reaches into the next one
                own, of = ids[k : k + STEP + window], row[k : k + STEP + window]
                pairs = []
                for step in range(1, window + 1):
                    first, second = own[:-step][:STEP], own[step:][:STEP]
                    same = of[:-step][:STEP] == of[step:][:STEP]
                    a, b = first[same], second[same]
                    pairs.append(np.minimum(a, b) * size + np.maximum(a, b))
                held = added(held, *np.unique(np.concatenate(pairs), return_counts=True))
                if len(held[0]) >= PAIRS:
                    yield rows(*held)
                    held = np.empty(0, np.int64), np.empty(0, np.int64)
        yield rows(*held)

    counted = df.select(_col(tokens).alias("tokens")).mapInArrow(run, "w int, c int, n bigint")
    return counted.groupBy("w", "c").agg(F.sum("n").alias("n"))


def both_ways(counts: DataFrame) -> DataFrame:
    """Every pair as ``(w, c)`` and ``(c, w)``; a word beside itself counts twice."""
    turned = counts.select(F.col("c").alias("w"), F.col("w").alias("c"), "n")
    same = F.col("w") == F.col("c")
    return counts.withColumn("n", F.when(same, F.col("n") * 2).otherwise(F.col("n"))).union(turned.filter(~same))


def positive_information(counts: DataFrame) -> DataFrame:
    """``(w, c, p)``: ``ln(n * total / (n_w * n_c))`` where that is positive."""
    own = F.broadcast(stable(counts.groupBy("w").agg(F.sum("n").alias("n_w"))))  # a row a word
    total = own.agg(F.sum("n_w")).scalar()
    other = own.select(F.col("w").alias("c"), F.col("n_w").alias("n_c"))
    chance = F.col("n") * total.cast("double") / (F.col("n_w") * F.col("n_c"))
    return counts.join(own, "w").join(other, "c").select("w", "c", F.log(chance).alias("p")).filter("p > 0")


def cooccurrence_vectors(
    df: DataFrame,
    tokens: Column | str,
    num_words: int,
    dim: int = 96,
    window: int = 5,
    seed: int = 42,
) -> DataFrame:
    """``(term, vector)`` of unit length for the ``num_words`` most frequent words that have a
    neighbour they meet more often than by chance."""
    vocab = fit_vocabulary(df, tokens, num_words + 1)
    terms = [r["term"] for r in sorted(vocab.collect(), key=lambda r: r["idx"])]  # capped
    known = df.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))
    counts = both_ways(stable(pair_counts(df, tokens, terms, window)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            w, c, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("w", "c", "p"))
            for i in np.unique(c).tolist():
                if i not in drawn:
                    drawn[i] = np.random.default_rng([seed, i]).standard_normal(dim).astype(np.float32)
            order = np.argsort(w, kind="stable")
            w, c, p = w[order], c[order], p[order]
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(w)]):
                own = p[a:b] @ np.stack([drawn[i] for i in c[a:b].tolist()])
                sums[int(w[a])] = sums.get(int(w[a]), 0) + own
        if sums:
            found = np.stack(list(sums.values()))
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            offsets = pa.array(np.arange(0, found.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    known.value.take(pa.array(list(sums), pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.float32).ravel())),
                ],
                ["term", "vector"],
            )

    # a word has at most as many rows as the vocabulary has words
    ready = positive_information(counts).repartition("w")
    return ready.mapInArrow(project, "term string, vector array<float>")
