"""TF-IDF and chi-square selection in long form: one row per document and term.

Terms are counted inside the row that holds the document, so counting needs no
shuffle; the only exchange over terms is the document-frequency aggregate, which
pre-aggregates per task. Chosen vocabularies are capped and therefore broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.text import _col, let
from textprep.operators.joins import lookup_terms
from textprep.session import pin_small, stable


def count_terms(tokens: Column | str) -> Column:
    """``array<struct<term, tf>>`` of one token array: sort it, then measure the runs."""

    def runs(s: Column) -> Column:
        def starts_run(i: Column) -> Column:
            return (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))

        def entries(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, j: F.struct(
                    F.get(s, at - 1).alias("term"),
                    (F.coalesce(F.get(starts, j + 1), F.size(s) + 1) - at)
                    .cast("bigint")
                    .alias("tf"),
                ),
            )

        return let(F.filter(F.sequence(F.lit(1), F.size(s)), starts_run), entries)

    t = _col(tokens)
    return F.when(F.size(t) > 0, let(F.array_sort(t), runs))


def term_counts(df: DataFrame, tokens: Column | str, keys: list[str]) -> DataFrame:
    """``keys + (term, tf)``."""
    return df.select(*keys, F.inline(count_terms(tokens)))


def term_stats(counts: DataFrame) -> DataFrame:
    """``(term, df, tf)``: documents with the term, and its total count."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def document_total(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery, evaluated once with the query that uses it."""
    return df.agg(F.count("*").alias("n")).scalar()


def df_bounds(
    stats: DataFrame, n_docs: Column | int, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most the share ``max_df`` of them."""
    total = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return stats.filter((F.col("df") >= min_df) & (F.col("df") <= total * max_df))


CELLS = 1 << 24  # of the sketch: 2 MB of bits in each task
BLOCK = 1 << 16


def _cell(term: Column, cells: int) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit(cells - 1)).cast("int")


SLICE = 100_000  # tokens that a task works on at once


def slicer(column: str, most: int = SLICE) -> Callable:
    """A function that cuts Arrow batches between rows, into pieces of ``most`` entries of a list
    column or of one row: a batch holds thousands of documents of any length.

    It is sent to the workers as it is and refers to nothing of this package.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0)
            ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
                yield batch.slice(at, max(upto - at, 1))
                at = max(upto, at + 1)

    return cut


def sketch(df: DataFrame, tokens: Column | str, min_df: int, cells: int = CELLS) -> DataFrame:
    """``block, bits``: the cells of a count-min sketch that ``min_df`` documents or more fall into.

    Documents are counted a cell, not a term, in one array per task that stops counting at
    ``min_df``; what the tasks exchange are the places and counts that are not zero, by block.
    """
    kind, cut = np.uint8 if min_df < 256 else np.uint32, slicer("cells")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, total = pa.Codec("zstd").compress, np.zeros(cells, kind)
        for batch in cut(batches):
            found = pc.list_flatten(batch.column("cells")).to_numpy(zero_copy_only=False)
            at, n = np.unique(found, return_counts=True)
            total[at] = np.minimum(total[at] + n, min_df)
        total = total.reshape(-1, min(BLOCK, cells))
        for block in np.flatnonzero(total.any(axis=1)).tolist():
            at = np.flatnonzero(total[block])
            gaps = np.diff(at, prepend=0).astype(np.uint16)
            packed = [pack(gaps.tobytes(), asbytes=True), pack(total[block][at].tobytes(), asbytes=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([len(at)], pa.int32()), *(pa.array([c], pa.binary()) for c in packed)],
                ["block", "n", "gaps", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        unpack = pa.Codec("zstd").decompress
        for batch in batches:
            for block, n, gaps, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(block, np.zeros(min(BLOCK, cells), np.uint32))
                at = np.cumsum(np.frombuffer(unpack(gaps, 2 * n), np.uint16), dtype=np.int64)
                own = np.frombuffer(unpack(counts, n * kind().itemsize), kind)
                total[at] = np.minimum(total[at] + own, min_df)
        bits = [np.packbits(t >= min_df, bitorder="little").tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"]
        )

    own = F.array_distinct(F.transform(_col(tokens), lambda t: _cell(t, cells)))
    counted = df.select(own.alias("cells")).mapInArrow(count, "block int, n int, gaps binary, counts binary")
    return counted.repartition("block").mapInArrow(add, "block int, bits binary")


def _frequent_terms(
    df: DataFrame, tokens: Column | str, min_df: int, cells: int, part: Column | None = None, parts: int = 1
) -> DataFrame:
    """``(term, df, tf)`` of the terms in ``min_df`` documents or more, and of others that share
    a cell with such terms: never fewer. One partial row per term and batch is exchanged.

    With ``part``, a number below ``parts`` for every document, ``df`` and ``tf`` are lists of the
    counts in each part; ``min_df`` goes by all documents."""
    block = min(BLOCK, cells)
    bits = np.zeros((cells // block, block // 8), np.uint8)
    for row in sketch(df, tokens, min_df, cells).toLocalIterator():  # cells / 8 bytes at most
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    cut = slicer("tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in cut(batches):
            lists = batch.column("tokens")
            cell = pc.list_flatten(batch.column("cells")).to_numpy(zero_copy_only=False)
            kept = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            words = pc.list_flatten(lists).filter(pa.array(kept)).dictionary_encode()
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[kept]
            term = words.indices.to_numpy(zero_copy_only=False)
            size = len(words.dictionary)
            own = batch.column("part").to_numpy(zero_copy_only=False)
            once_row, once = np.divmod(np.unique(row * size + term), max(size, 1))
            n = [
                np.bincount(t * parts + own[r], minlength=size * parts)
                for r, t in ((once_row, once), (row, term))
            ]
            ends = pa.array(np.arange(0, size * parts + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.cast(pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in n)],
                ["term", "df", "tf"],
            )

    own = F.lit(0) if part is None else part
    rows = df.select(_col(tokens).alias("tokens"), own.cast("int").alias("part"))
    rows = rows.select("tokens", "part", F.transform("tokens", lambda t: _cell(t, cells)).alias("cells"))
    counted = rows.mapInArrow(count, "term string, df array<bigint>, tf array<bigint>")
    sums = [[F.sum(F.get(c, F.lit(i))) for i in range(parts)] for c in ("df", "tf")]
    if part is None:
        return counted.groupBy("term").agg(sums[0][0].alias("df"), sums[1][0].alias("tf"))
    return counted.groupBy("term").agg(F.array(*sums[0]).alias("df"), F.array(*sums[1]).alias("tf"))


def terms_of_fits(
    df: DataFrame,
    tokens: Column | str,
    min_df: int,
    max_df: float,
    max_features: int,
    fold: str | None = None,
    folds: int = 0,
    cells: int = CELLS,
) -> list[str]:
    """Sorted terms of the capped vocabulary of all documents, and of those of all but one fold.

    Documents are taken apart once for all of them: a term is counted by fold, and what a fit
    without a fold sees is the difference.
    """
    part = F.lit(0)
    if fold is not None:
        part = F.when(F.col(fold).between(0, folds - 1), F.col(fold)).otherwise(folds).cast("int")
    n = np.zeros(folds + 1, np.int64)
    for row in df.select(part.alias("part")).groupBy("part").count().collect():
        n[row["part"]] = row["count"]
    if min_df > 1:
        stats = _frequent_terms(df, tokens, min_df, cells, part, folds + 1)
    else:
        counts = term_counts(df.select(part.alias("part"), _col(tokens).alias("tokens")), "tokens", ["part"])
        own = [F.col("part") == i for i in range(folds + 1)]
        stats = counts.groupBy("term").agg(
            F.array(*[F.count_if(o) for o in own]).alias("df"),
            F.array(*[F.sum(F.when(o, F.col("tf")).otherwise(0)) for o in own]).alias("tf"),
        )
    stats = stable(stats)
    found = None
    for left_out in [None, *range(folds)]:
        seen = [i for i in range(folds + 1) if i != left_out]
        total = {c: sum((F.get(c, F.lit(i)) for i in seen), F.lit(0)).alias(c) for c in ("df", "tf")}
        own = df_bounds(stats.select("term", *total.values()), int(n[seen].sum()), max(min_df, 1), max_df)
        own = cap_vocabulary(own, max_features).select("term")
        found = own if found is None else found.union(own)
    return sorted(r["term"] for r in found.distinct().collect())


def bounded_terms(
    df: DataFrame,
    tokens: Column | str,
    n_docs: Column | int,
    min_df: int = 1,
    max_df: float = 1.0,
    cells: int = CELLS,
) -> DataFrame:
    """``(term, df, tf)`` within the bounds, as :func:`df_bounds` has it, from the documents.

    Rare terms are most of a vocabulary. A sketch drops them before any term is counted or
    shuffled; those it keeps by chance are counted exactly and fall to ``min_df`` afterwards.
    The larger the vocabulary is against ``cells``, the more of them it keeps.
    """
    if min_df > 1:
        stats = _frequent_terms(df, tokens, min_df, cells)
    else:
        stats = term_stats(term_counts(df, tokens, []))
    return df_bounds(stats, n_docs, min_df, max_df)


def cap_vocabulary(stats: DataFrame, max_features: int) -> DataFrame:
    """The terms with the largest total count, ties by term."""
    return stats.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)


def smooth_idf(df_column: Column | str, n_docs: Column | int) -> Column:
    total = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((total + 1.0) / (_col(df_column) + 1.0)) + 1.0


def tfidf_weights(
    counts: DataFrame,
    vocab: DataFrame,
    n_docs: Column | int,
    keys: list[str],
    max_features: int | None = None,
) -> DataFrame:
    """``keys + (term, weight)``: sublinear TF times smoothed IDF, unit length per document.

    A document's entries are gathered before the exchange, which carries one row
    per document; the length is then a computation inside that row.
    """
    idf = vocab.select("term", "df", smooth_idf("df", n_docs).alias("idf"))
    found = lookup_terms(counts, idf, ["idf"], [F.desc("df")], max_features)
    raw = found.filter("idf is not null").withColumn(
        "w", (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")
    )
    rows = raw.groupBy(*keys).agg(F.collect_list(F.struct("term", "w")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    return (
        rows.withColumn("norm", norm)
        .select(*keys, "norm", F.inline("e"))
        .select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight"))
    )


def weigh_documents(
    df: DataFrame,
    tokens: Column | str,
    vocab: DataFrame,
    n_docs: Column | int,
    keys: list[str],
    max_features: int,
) -> DataFrame:
    """:func:`tfidf_weights` straight from the documents: counted and weighed inside the row.

    The vocabulary, of ``max_features`` rows at most, goes to every task as sorted columns. A
    batch's tokens are looked up in it at once, equal ones of a document are counted as equal
    numbers, and weights have unit length before a row leaves; nothing is exchanged. A larger
    vocabulary is not cut but takes the long way over :func:`term_counts`.
    """
    idf = vocab.select("term", "df", smooth_idf("df", n_docs).alias("idf"))
    known = idf.select("term", "idf").limit(max_features + 1).toArrow()
    if known.num_rows > max_features:
        return tfidf_weights(term_counts(df, tokens, keys), vocab, n_docs, keys)
    known = known.sort_by("term")
    terms = known.column("term").combine_chunks().cast(pa.string())
    scale = known.column("idf").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((terms, scale))
    cut = slicer("_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, scale = shared.value
        for batch in cut(batches):
            lists = batch.column("_tokens")
            at = pc.index_in(pc.list_flatten(lists).cast(pa.string()), value_set=terms)
            hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit]
            place = row * len(terms) + pc.drop_null(at).to_numpy(zero_copy_only=False)
            entry, tf = np.unique(place, return_counts=True)
            row, term = np.divmod(entry, max(len(terms), 1))
            weight = (np.log(tf.astype(np.float64)) + 1.0) * scale[term]
            norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(row)) for k in keys),
                    terms.take(pa.array(term)), pa.array(weight / norm[row]),
                ],
                [*keys, "term", "weight"],
            )

    rows = df.select(*keys, _col(tokens).alias("_tokens"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{fields}, term string, weight double")


def chi2_scores(weights: DataFrame, sizes: dict, label: str = "label") -> DataFrame:
    """``(term, chi2)`` of continuous weights against the class.

    ``sizes`` are the documents per class, as ``class_sizes`` returns them. Expected is
    the class share of the term's total, and the statistic ``sum((o - e)^2 / e)``
    equals ``sum(o^2 / e) - total``: classes without the term need no rows of their own.
    """
    n, kind = sum(sizes.values()), weights.schema[label].dataType.simpleString()
    shares = F.broadcast(
        weights.sparkSession.createDataFrame(
            [(c, m / n) for c, m in sizes.items()], f"{label} {kind}, share double"
        )
    )
    observed = weights.groupBy("term", label).agg(F.sum("weight").alias("o"))
    return (
        observed.join(shares, label)
        .groupBy("term")
        .agg(F.sum("o").alias("total"), F.sum(F.col("o") * F.col("o") / F.col("share")).alias("s"))
        .select("term", (F.col("s") / F.col("total") - F.col("total")).alias("chi2"))
    )


def select_k_best(scores: DataFrame, k: int, score: str = "chi2", digits: int = 9) -> DataFrame:
    """The ``k`` best terms. Scores are compared rounded, so that the order in which
    sums were added up does not decide between equal ones; ties go by term."""
    return scores.orderBy(F.desc(F.round(score, digits)), F.asc("term")).limit(k)


def project_terms(weights: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """The weights of the selected terms, of which there should be ``k`` at most."""
    return weights.join(pin_small(selected.select("term"), k), "term", "left_semi")
