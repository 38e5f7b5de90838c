"""Toxicity by compression: which of two zstandard dictionaries shortens a window more.

A window is a word written as its overlapping pieces of four, five and six letters, so that
stems count as well as whole words and a known word saves many bytes. One dictionary is trained on windows typical of toxic texts, the other on
ordinary windows, those that the toxic one took for its own included. A text's distance is
the largest gain in bytes of the toxic dictionary over the ordinary one among its windows, or
the second largest plus two. The distance is turned into a score by the share of toxic texts
at each distance, over labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.common import ship, write_once

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (4, 5, 6)
LOWEST, HIGHEST = -5, 60
KEPT_WINDOWS = 500_000
MAX_BYTES = 200_000_000  # of sample texts on the driver


def words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def pieces(word: str, size: int = SIZES[0]) -> list[str]:
    bounded = f" {word} "
    return [bounded[i : i + size] for i in range(max(1, len(bounded) - size + 1))]


def window(word: str) -> bytes:
    return "".join("".join(pieces(word, size)) for size in SIZES).encode()


class Gain:
    """Bytes that the toxic dictionary saves on a word over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        shape = zstandard.ZstdCompressionParameters.from_level(
            3, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        self.ordinary, self.toxic = (
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d), compression_params=shape
            )
            for d in (ordinary, toxic)
        )
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        gain = self.known.get(word)
        if gain is None:
            if len(self.known) >= KEPT_WINDOWS:
                self.known.clear()
            text = window(word)
            gain = len(self.ordinary.compress(text)) - len(self.toxic.compress(text))
            if len(word) < 100:
                self.known[word] = gain
        return gain

    def distance(self, text: str) -> int:
        first = second = LOWEST - 2
        for word in words(text):
            gain = self(word)
            if gain > first:
                first, second = gain, first
            elif gain > second:
                second = gain
        return min(HIGHEST, max(LOWEST, first, second + 2))


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    scores: tuple[float, ...]  # by distance from LOWEST

    def score(self, gain: Gain, text: str) -> float:
        return self.scores[gain.distance(text) - LOWEST]


def typical_words(rows: list[tuple[str, int]]) -> tuple[set[str], set[str]]:
    """Words of toxic texts, and of no ordinary one, with a piece that toxic texts hold at
    least thirty times as often; and all words of ordinary texts.

    Texts are taken apart one by one: what stays is as large as their vocabulary.
    """
    counts, found, many = (Counter(), Counter()), (set(), set()), [0, 0]
    for text, y in rows:
        own = words(text)
        counts[y].update({q for x in own for q in pieces(x)})
        found[y].update(own)
        many[y] += 1
    least = max(3, 0.01 * many[1])
    telling = {
        p
        for p, n in counts[1].items()
        if n >= least and n / many[1] > 30 * (counts[0][p] + 0.2) / many[0]
    }
    typical = {x for x in found[1] if x not in found[0] and not telling.isdisjoint(pieces(x))}
    return typical, found[0]


def train_dictionary(size: int, windows: list[bytes]) -> bytes:
    """A zstandard dictionary; few windows are repeated until they suffice to train one."""
    windows = windows * (1 + 300 // len(windows))
    return zstandard.train_dictionary(size, windows, k=32, d=6).as_bytes()


def rising(hits: list[float], totals: list[float]) -> list[float]:
    """Shares by place, made non-decreasing by pooling neighbours."""
    pools: list[list[float]] = []
    for hit, total in zip(hits, totals):
        pools.append([hit, total, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [hit / total for hit, total, many in pools for _ in range(int(many))]


def fit_texts(rows: list[tuple[str, int]], seed: int = 7) -> ToxicityModel | None:
    """A model of ``(text, label)``; None without several texts of both labels.

    Equal texts count once. Two thirds of the texts train the dictionaries, the rest
    calibrates.
    """
    rows = sorted(set(rows))
    random.Random(seed).shuffle(rows)
    cut = 2 * len(rows) // 3
    if any(sum(label == y for _, label in rows[:cut]) < 3 for y in (0, 1)):
        return None
    typical, known = typical_words(rows[:cut])
    if not typical:
        return None
    toxic = train_dictionary(32_768, [window(x) for x in sorted(typical)])
    clean = sorted(known)
    chosen = random.Random(seed).sample(clean, min(30_000, len(clean)))
    sample = [window(x) for x in chosen]
    ordinary = train_dictionary(112_640, sample)
    for _ in range(2):
        gain = Gain(ordinary, toxic)
        mistaken = [window(x) for x in clean if gain(x) >= 5]
        sample += mistaken * 5
        random.Random(seed).shuffle(sample)
        ordinary = train_dictionary(112_640, sample)
    gain = Gain(ordinary, toxic)
    places = HIGHEST - LOWEST + 1
    prior = sum(y for _, y in rows) / len(rows)
    hits, totals = [0.1 * prior] * places, [0.1] * places
    for text, y in rows[cut:]:
        place = gain.distance(text) - LOWEST
        hits[place] += y
        totals[place] += 1
    return ToxicityModel(ordinary, toxic, tuple(rising(hits, totals)))


def in_training(key: Column) -> Column:
    """Rows whose label may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = 3_000,
    max_ordinary: int = 6_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes: int = MAX_BYTES,
) -> ToxicityModel | None:
    """Fit on a bounded sample of the labelled rows that may be learned from.

    At most ``max_toxic`` and ``max_ordinary`` ids, those first in the order of a hash, are
    looked up by a broadcast of these ids. Of the different texts found, at most as many again
    a label are collected, one of each id before further ones, and at most half of ``max_bytes``
    of UTF-8 a label; texts that no longer fit are passed over. Before that only digests and
    sizes are shuffled. Rows without id, label or text are left out.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("_toxic")).filter(
        in_training(F.col("_id")) & F.col("_toxic").isin(0, 1)
    )
    by_hash = (F.md5(F.col("_id").cast("string")), "_id", "_toxic")
    chosen = usable.filter("_toxic = 1").orderBy(*by_hash).limit(max_toxic).unionAll(
        usable.filter("_toxic = 0").orderBy(*by_hash).limit(max_ordinary)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.filter("_text is not null")
    told = write_once(
        texts.join(F.broadcast(chosen.distinct()), "_id")
        .withColumns({"_digest": F.xxhash64("_text"), "_bytes": F.octet_length("_text")})
        .groupBy("_toxic", "_digest")
        .agg(F.min("_id").alias("_id"), F.max("_bytes").alias("_bytes"))
    )
    least = told.groupBy("_toxic", "_id").agg(F.min("_digest").alias("_least"))  # a row for each id
    ordered = told.join(F.broadcast(least), ["_toxic", "_id"]).orderBy(
        F.col("_digest") != F.col("_least"), F.md5(F.col("_id").cast("string")), "_digest"
    )
    kept: list[tuple] = []
    for toxic, most in ((1, max_toxic), (0, max_ordinary)):
        left = max_bytes // 2
        for r in ordered.filter(F.col("_toxic") == toxic).limit(most).collect():
            if r["_bytes"] <= left:
                left -= r["_bytes"]
                kept.append((r["_id"], r["_digest"], toxic))
    if not kept:
        return None
    kind = dict(chosen.dtypes)["_id"]
    named = docs.sparkSession.createDataFrame(kept, f"_id {kind}, _digest long, _toxic int")
    found = (
        texts.join(F.broadcast(named.select("_id").distinct()), "_id", "left_semi")
        .withColumn("_digest", F.xxhash64("_text"))
        .join(F.broadcast(named), ["_id", "_digest"])
        .groupBy("_toxic", "_digest")
        .agg(F.first("_text").alias("_text"))
    )
    return fit_texts([(r["_text"], r["_toxic"]) for r in found.select("_text", "_toxic").collect()])


def score(model: ToxicityModel | None, text: Column) -> Column:
    """Score of a text, 0 to 1; a null text counts as empty; 0 without a model."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = Gain(model.ordinary, model.toxic)  # ends with the task; workers stay for later stages
        for texts in batches:
            yield pa.array([model.score(gain, x.as_py() or "") for x in texts], pa.float64())

    return apply(text)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts have no window and get the lowest score. Repeated rows are scored
    alike; a null id is not held out (null has no remainder). Other columns are not read.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (~F.coalesce(in_training(F.col(id_col)), F.lit(True))).alias("held_out"),
        score(model, F.col(text_col)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """The rows that score below the threshold, with the columns they came with."""
    ship(docs.sparkSession)
    model = fit(docs, labels, text_col=text_col)
    return docs.filter(score(model, F.col(text_col)) < threshold)
