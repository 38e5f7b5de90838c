"""Jaccard self-join of documents by word n-grams, and the classes that its links form.

Documents of equal n-gram sets are one node. Sizes fall into bands. Two sets that are similar
enough differ in a few n-grams at most, and how few follows from the band of the smaller one.
So each band deals n-grams by hash into more parts than that: some part is whole and equal in
both sets. A tile is a band, a part, and the hash of what a set has in it; sets meet in tiles
because a stretch of their n-grams agrees, not because they share a frequent one. A set goes to
its own band's tiles, and to the band's below if that one's sets can be similar to it.

First every node of a tile is compared with the tile's smallest node of a fitting size, which
joins most of a group of copies at a cost in proportion to the tile. Then, only in tiles that
hold nodes of different classes, all pairs across classes are compared, in blocks of bounded
size. A comparison asks signatures first, bitmaps of hashed n-grams: bits of one that the other
lacks bound the overlap from above. Pairs that pass are counted exactly on sorted arrays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.common import parallelism, ship, text_slices, write_once, write_small
from textprep.llm.components import components

BLOCK = 1024  # rows of a block in the comparison across classes
SHARE = 16  # the first round across classes looks at one tile of so many,
SMALL = 4  # and names so few pairs a node and block
WIDEST = 1.5  # largest size of a band against that of the band below
BROADCAST_ROWS = 2_000_000


def ngram_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z in lower case.

    Words are runs without ASCII white space. A text of fewer words is one n-gram; one
    without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        if not words:
            return np.empty(0, dtype=np.int64)
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = np.zeros(count, np.uint64)
    for i in range(width):  # of one multiply and shift a word, so that the order counts
        mixed = (mixed ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def set_key(ngrams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ngrams.tobytes()) - (1 << 63)


def signature(ngrams: np.ndarray, percent: int) -> bytes:
    """A bitmap of hashed n-grams: a bit is set if an odd number of them falls on it.

    Bits in which two sets differ are n-grams that one of them lacks, or more of these, so
    their count bounds the overlap from above, however full the bitmaps are. Eight bits for
    each n-gram that similar sets may differ in keep most of these apart, so the bound is close.
    """
    differ = 2 * len(ngrams) * (100 - percent) // (100 + percent)
    bits = max(64, 1 << (8 * differ).bit_length())
    at = (ngrams.view(np.uint64) >> np.uint64(16)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The signature that the same set has at a smaller size, in 64-bit words."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def allowed(unlike: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose sizes add up to ``total`` can be similar with so many unlike bits."""
    return (100 + percent) * unlike <= (100 - percent) * total


@functools.lru_cache(maxsize=64)
def bands(largest: int, percent: int) -> np.ndarray:
    """Bands for sets of up to ``largest`` n-grams: ``upto``, the largest size; ``reach``, the
    largest size that can be similar to one of it; ``parts`` and ``spare``.

    Similar sets of sizes n <= ``upto`` and m <= ``reach`` differ in at most
    ``(100 - percent) / (100 + percent) * (n + m)`` n-grams. With ``spare + 1`` parts more than
    that, they agree in more than ``spare`` whole parts, so in one that is not empty unless
    both have more than ``spare`` empty parts; ``spare`` is what the smallest set of the band
    hardly ever exceeds.
    """
    rows, upto = [], 0
    while not rows or upto < largest:
        low, upto = upto + 1, max(upto + 1, int(upto * WIDEST))
        reach = 100 * upto // percent
        differ = (100 - percent) * (upto + reach) // (100 + percent)
        spare = 0
        while spare < 4 * differ:
            empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
            if spare >= empty + 3 * math.sqrt(empty):
                break
            spare += 1
        # sets that may not differ are equal, so one node
        rows.append((upto, reach, differ + 1 + spare if differ else 0, spare))
    return np.array(rows, [("upto", "i8"), ("reach", "i8"), ("parts", "i8"), ("spare", "i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places (the finaliser of a well-known hash)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tiles_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``place, tile``: the tiles of every set, by its place in the list.

    A set with more empty parts than its band spares also goes by its first n-grams, in the
    order of their hashes: similar sets share one of those (prefix filter). The exact way for
    the few sets that the parts may miss.
    """
    sizes = np.array([len(x) for x in sets])
    # a power of two, so that few are made; bands above the largest set are not used
    known = bands(1 << int(sizes.max(initial=1) - 1).bit_length(), percent)
    own = np.searchsorted(known["upto"], sizes)
    places, tiles = [], []
    for back in range(len(known)):
        band = own - back
        going = (sizes > 0) & (band >= 0) & (sizes <= known["reach"][band])
        if not going.any():
            break
        chosen = np.flatnonzero(going & (known["parts"][band] > 0))
        if not len(chosen):
            continue
        band, size = band[chosen], sizes[chosen]
        row = np.repeat(np.arange(len(chosen)), size)
        ngram = np.concatenate([sets[i] for i in chosen.tolist()]).view(np.uint64) ^ np.uint64(1 << 63)
        # n-grams are sorted, so a range of hashes is a run
        part = ((ngram >> np.uint64(32)) * known["parts"][band][row].astype(np.uint64)) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(_mixed(ngram), cuts)
            name = band[row[cuts]].astype(np.uint64) * np.uint64(1 << 40) + part[cuts]
            tile = _mixed(content + _mixed(name))
        places.append(chosen[row[cuts]])
        tiles.append(tile.view(np.int64))
        filled = np.bincount(row[cuts], minlength=len(chosen))
        for i in np.flatnonzero(known["parts"][band] - filled > known["spare"][band]).tolist():
            first = sets[chosen[i]].view(np.uint64)
            first = first[: size[i] - -(-percent * size[i] // 100) + 1]
            with np.errstate(over="ignore"):
                name = _mixed(np.array([(int(band[i]) + 1) << 41], np.uint64))
                tiles.append(_mixed(first + name).view(np.int64))
            places.append(np.full(len(first), chosen[i]))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(tiles)


def _batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(step, text_slices(batches))

    return df.mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _surveyed(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, digest, key, n, signature`` of every row; no key without n-grams."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [ngram_set(t, width) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("digest"),
                pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([signature(x, percent) for x in sets], pa.binary()),
            ],
            ["doc_id", "digest", "key", "n", "signature"],
        )

    return _batches(texts, step, "doc_id long, digest long, key long, n long, signature binary")


def _postings(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``tile, key, n`` of every set, equal sets of a task once."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in text_slices(batches):
            fresh: dict[int, np.ndarray] = {}
            for text in piece.column("text").to_pylist():
                ngrams = ngram_set(text, width)
                key = set_key(ngrams)
                if len(ngrams) and key not in seen:
                    fresh[key] = ngrams
                    seen.add(key)
            place, tile = tiles_of(list(fresh.values()), percent)
            keys = np.array(list(fresh), np.int64)
            sizes = np.array([len(x) for x in fresh.values()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile), pa.array(keys[place]), pa.array(sizes[place])], ["tile", "key", "n"]
            )

    return texts.select("text").mapInArrow(run, "tile long, key long, n long")


def _tiles(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of tiles that several nodes are in, with the node to compare with first.

    Reads rows sorted by tile and size as a stream, so a tile of any size needs no memory.
    ``other`` is the smallest node of the tile within reach of sizes, null for itself.
    """
    spark = postings.sparkSession
    ordered = postings.repartition(parallelism(spark), "tile").sortWithinPartitions("tile", "n", "key")
    names = ["tile", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)  # the last row, and the one before it
        pivot = (None, 0, 0)

        def told(rows: np.ndarray, mine: np.ndarray) -> pa.RecordBatch:
            nonlocal pivot
            other, other_n = [], []
            for tile, key, n in rows[mine].tolist():
                if pivot[0] != tile or 100 * pivot[2] < percent * n:
                    pivot = (tile, key, n)
                    other.append(None)
                    other_n.append(None)
                else:
                    other.append(pivot[1])
                    other_n.append(pivot[2])
            arrays = [pa.array(rows[mine][:, i]) for i in range(3)]
            arrays += [pa.array(other, pa.int64()), pa.array(other_n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "other", "other_n"])

        for batch in batches:
            rows = np.concatenate([held, np.stack(_columns(batch, *names), axis=1)])
            fresh = np.ones(len(rows), bool)  # equal sets of several batches are one node
            fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            rows = rows[fresh]
            follows = np.zeros(len(rows), bool)
            follows[1:] = rows[1:, 0] == rows[:-1, 0]
            mine = follows.copy()
            mine[:-1] |= follows[1:]
            mine[-1] = False  # told with the next batch
            if len(held) == 2:
                mine[0] = False  # told before
            yield told(rows, mine)
            held = rows[-2:]
        if len(held) == 2 and held[0, 0] == held[1, 0]:
            yield told(held, np.array([False, True]))

    return ordered.mapInArrow(run, "tile long, key long, n long, other long, other_n long")


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _linked(
    pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """The pairs ``a, b`` that are similar enough: signatures first, then exact overlap.

    Only nodes of pairs that the signatures allow have their n-grams made again from the text.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes, total: int) -> bool:
            words = min(len(x), len(y)) // 8
            unlike = np.bitwise_count(folded(_words(x), words) ^ folded(_words(y), words)).sum(dtype=np.int64)
            return bool(allowed(unlike, total, percent))

        return pd.Series([one(*row) for row in zip(a, b, n + m)], dtype=bool)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> bool:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    def with_ends(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for end in ("a", "b"):
            side = table.select(F.col("key").alias(end), F.col(column).alias(f"{end}_{column}"))
            rows = rows.join(side, end)
        return rows

    mapped = with_ends(pairs, nodes, "signature").filter(possible("a_signature", "b_signature", "n", "m"))
    mapped = write_small(mapped.select("a", "b").distinct())
    ends = mapped.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    exact = with_ends(mapped, _sets(texts, nodes, ends, width), "ngrams")
    return exact.filter(similar("a_ngrams", "b_ngrams")).select("a", "b").distinct()


def _across(
    tiles: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int, share: int, most: int
) -> DataFrame:
    """Pairs ``a, b, n, m`` of nodes of different classes in one tile that sizes and signatures
    allow; of every ``share``-th tile, and of each node the ``most`` likeliest.

    Only tiles of several classes are looked at. A tile is cut into blocks, and pairs of blocks
    are compared: each node outside their largest class with the nodes of other classes.
    """
    spark = tiles.sparkSession
    known = classes.select(F.col("node").alias("key"), "component")
    placed = write_once(
        tiles.filter(F.pmod(F.xxhash64("tile"), F.lit(share)) == 0)
        .select("tile", "key", "n")
        .join(known, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    mixed = (
        placed.groupBy("tile")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
            F.min(F.struct("n", "key")).alias("first"),
        )
        .filter("low < high")
        .select("tile", "blocks", F.col("first.key").alias("first"))
    )
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")),
    )
    rows = (
        placed.join(mixed, "tile")
        .join(nodes.select("key", "signature"), "key")
        .select("first", "tile", "key", "n", "component", "signature", own.alias("own"), F.explode(others).alias("t"))
        .select("first", "tile", "t.i", "t.j", "own", "key", "n", "component", "signature")
        # tiles of one group mostly begin with the same node: a task that has them all names a
        # pair once, and a large group is still spread by its blocks
        .repartition(parallelism(spark), "first", "i", "j")
        .sortWithinPartitions("tile", "i", "j", "n", "key")
        .drop("first")
    )
    ship(spark)
    names = ["tile", "i", "j", "own", "key", "n", "component"]

    def compared(tile: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[list[int], ...]]:
        i, j, own, key, n, component = tile.T[1:]
        found, counts = np.unique(component, return_counts=True)
        outside = component != found[counts.argmax()]
        low = np.searchsorted(n, -(-percent * n // 100))
        high = np.searchsorted(n, 100 * n // percent, side="right")
        at_size: dict[int, np.ndarray] = {}  # all signatures at a size, where it is enough
        words = np.array([len(m) for m in maps])
        for at in np.flatnonzero(outside).tolist():
            to = np.arange(low[at], high[at])
            # of two outside the largest class, the later one asks
            to = to[(component[to] != component[at]) & (~outside[to] | (to < at))]
            if i[at] != j[at]:
                to = to[own[to] != own[at]]
            if not len(to):
                continue
            size = int(min(words[at], words[to].min()))
            if size not in at_size:
                at_size[size] = np.stack([folded(m, size) if len(m) >= size else np.zeros(size, np.uint64) for m in maps])
            there = at_size[size]
            unlike = np.bitwise_count(there[to] ^ there[at]).sum(axis=1, dtype=np.int64)
            fits = allowed(unlike, n[to] + n[at], percent)
            to, unlike = to[fits], unlike[fits]
            if len(to) > most:
                to = to[np.argsort(unlike, kind="stable")[:most]]
            yield [key[at]] * len(to), key[to].tolist(), [n[at]] * len(to), n[to].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.empty((0, 7), np.int64)
        held_maps: list[np.ndarray] = []
        told_before: set[tuple[int, int]] = set()  # of this task

        def told(rows: np.ndarray, maps: list[np.ndarray]) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            ends = [0, *cuts.tolist(), len(rows)]
            fresh = []
            for low, high in zip(ends, ends[1:]):
                for found in compared(rows[low:high], maps[low:high]):
                    for row in zip(*found):
                        if row[:2] not in told_before:
                            told_before.add(row[:2])
                            fresh.append(row)
            columns = list(zip(*fresh)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list("abnm"))

        for batch in batches:
            rows = np.concatenate([held, np.stack(_columns(batch, *names), axis=1).astype(np.int64)])
            maps = held_maps + [_words(x) for x in batch.column("signature").to_pylist()]
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            begin = len(rows) - int(last.sum())  # the last tile may go on
            if begin:
                yield told(rows[:begin], maps[:begin])
            held, held_maps = rows[begin:], maps[begin:]
        if len(held):
            yield told(held, held_maps)

    return rows.mapInArrow(run, "a long, b long, n long, m long")


def _sets(texts: DataFrame, nodes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """``key, ngrams`` of the nodes in ``keys``, from the text of one document each."""
    wanted = write_once(
        nodes.join(keys, "key", "left_semi").select("key", F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    )
    if wanted.count() <= BROADCAST_ROWS:  # three numbers a row
        wanted = F.broadcast(wanted)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[int, np.ndarray] = {}
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            ngrams = ngram_set(text, width)
            if set_key(ngrams) == key:
                out[key] = ngrams
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(out), pa.int64()),
                pa.array(list(out.values()), pa.list_(pa.int64())),
            ],
            ["key", "ngrams"],
        )

    # a repeated id may stand for other texts
    same = (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("of"))
    chosen = texts.join(wanted, same).select("key", "text")
    return write_once(_batches(chosen, step, "key long, ngrams array<bigint>"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), _digest(text_col).alias("digest"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _classes(texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, digest, key, n`` of every row; ``key, doc_id, digest, rows`` of every node, with
    the smallest id of its rows and the smallest digest of that id; ``key, component`` of the
    nodes that link."""
    rows = write_once(_surveyed(texts, width, percent))
    # a set is one node, whichever documents hold it
    nodes = write_once(
        rows.filter("doc_id is not null and key is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct("doc_id", "digest")).alias("of"), F.min("signature").alias("signature"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select("key", "of.doc_id", "of.digest", "signature", "rows")
    )
    tiles = write_once(
        _tiles(_postings(texts.filter("doc_id is not null"), width, percent), percent)
    )
    first = tiles.filter("other is not null").select(
        F.col("other").alias("a"), F.col("key").alias("b"), F.col("other_n").alias("n"), F.col("n").alias("m")
    )
    links = write_small(_linked(first.distinct(), nodes, texts, width, percent))
    tested = write_small(first.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    # nodes of one group meet in many tiles, and one link is enough to join two classes: few
    # tiles and few pairs a node first, more of both next, then all that is left between classes
    share, most = SHARE, SMALL
    while True:
        found = write_small(_across(tiles, components(links), nodes, percent, share, most))
        more = found.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
        more = more.dropDuplicates(["low", "high"]).join(tested, ["low", "high"], "left_anti")
        more = write_small(more)
        links = write_small(links.unionAll(_linked(more.select("a", "b", "n", "m"), nodes, texts, width, percent)))
        if share == 1:
            break
        tested = write_small(tested.unionAll(more.select("low", "high")))
        share, most = max(1, share // 4), 4 * most if share > 4 else 1 << 62
    return rows, nodes, components(links).withColumnRenamed("node", "key")


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """For joins with rows of a few numbers."""
    df = write_once(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS // 2 else df


def join(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link if their n-gram sets overlap by ``percent`` of their union or more;
    ``component_id`` is the smallest id that links reach. Texts that are null or have no word
    have no n-grams and link with nothing. Rows without id link with nothing and have no
    component. Rows of equal id are documents of their own that share a name. Other columns
    are not read; no rows give no rows.
    """
    rows, nodes, classes = _classes(_texts(docs, id_col, text_col), width, percent)
    least = nodes.join(classes, "key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_key = classes.join(least, "component").select("key", "component_id")
    single = nodes.select("key", F.col("doc_id").alias("least_id"))
    return rows.join(single, "key", "left").join(of_key, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "least_id", "doc_id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of every class, with the columns it came with: one of the smallest id.

    Of several texts of that id in the class the one of the smallest digest stays, of several
    rows of that text the one of the smallest hash. What an id's other texts do has no say.
    Rows without id or without words stay.
    """
    rows, nodes, classes = _classes(_texts(docs, id_col, text_col), width, percent)
    placed = nodes.join(classes, "key", "left").select(
        "key", F.coalesce("component", "key").alias("component"), "doc_id", "digest", "rows"
    )
    several = _broadcast_if_small(
        placed.groupBy("component")
        .agg(F.min(F.struct("doc_id", "digest")).alias("stays"), F.sum("rows").alias("rows"))
        .filter("rows > 1")
        .select("component", "stays")
    )
    of_key = _broadcast_if_small(placed.join(several, "component").select("key", "stays"))
    # rows of equal id and digest share a text and so a key
    told = write_once(
        rows.filter("doc_id is not null")
        .join(of_key, "key")
        .groupBy(F.col("doc_id").alias("_join_id"), F.col("digest").alias("_join_digest"))
        .agg(
            F.bool_and(F.struct("doc_id", "digest") == F.col("stays")).alias("stays"),
            F.count(F.lit(1)).alias("rows"),
        )
        .filter("not stays or rows > 1")
    )
    pair = ["_join_id", "_join_digest"]
    # whole rows as one column, so that no name of theirs can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    named = docs.select(
        row, F.col(f"`{id_col}`").cast("long").alias("_join_id"), _digest(text_col).alias("_join_digest")
    )
    kept = named.join(_broadcast_if_small(told.select(*pair)), pair, "left_anti").select("row")
    repeated = told.filter("stays").select(*pair)
    if repeated.isEmpty():
        return kept.select("row.*")
    again = (
        named.join(_broadcast_if_small(repeated), pair, "left_semi")
        .groupBy(*pair)
        .agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    )
    return kept.unionAll(again.select("row")).select("row.*")
