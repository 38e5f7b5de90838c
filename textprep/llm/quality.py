"""Quality rules that vote or abstain, weighed by expectation-maximisation.

Each rule votes for good, for bad, or abstains. How often a rule is right on good and on bad
texts is estimated from how the rules agree over all texts, without labels; a text is kept by
its posterior probability of being good. The estimate sees the counts of vote patterns only
(three to the power of the number of rules at most), so nothing of the size of the corpus
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textprep.llm.common import write_once

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _windows(hashes: Column) -> Column:
    """Hash of every window of eight words, from pairs of pairs of pairs."""

    def joined(step: int) -> Callable[[Column], Column]:
        def pairs(h: Column) -> Column:
            left = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(
                F.slice(h, F.lit(1), left), F.slice(h, F.lit(1 + step), left),
                lambda a, b: F.xxhash64(a, b),
            )

        return pairs

    for step in (1, 2, 4):
        hashes = _let(hashes, joined(step))
    return hashes


def _covered(windows: Column) -> Column:
    """Words in windows that are found twice or more."""
    numbered = F.array_sort(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def repeated(rows: Column) -> Column:
        def twin(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(rows, at)["h"] == x["h"], F.lit(False))

        return F.filter(
            rows, lambda x, i: (F.when(i > 0, twin(x, i - 1)).otherwise(False)) | twin(x, i + 1)
        )

    def spread(places: Column) -> Column:
        gaps = F.zip_with(
            F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places)),
            lambda a, b: F.least(F.lit(WINDOW), b - a),
        )
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    places = _let(numbered, lambda rows: F.array_sort(F.transform(repeated(rows), lambda x: x["i"])))
    found = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(found, _let(places, spread)).otherwise(0).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns plus ``_m``, a struct of what the rules look at; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumn("_words", words(text)).withColumn("_lines", lines)
    staged = staged.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    staged = staged.withColumn("_windows", _windows(F.col("_hashes")))
    # a generator of one value: what follows refers to the measures and does not repeat them
    return staged.select(
        *docs.columns,
        F.explode(F.array(F.struct(
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
            .cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines")))
            .cast("long").alias("n_dup_lines"),
            _covered(F.col("_windows")).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"[.!?。।]")).cast("long").alias("n_stops"),
        ))).alias("_m"),
    )


def _share(part: str, whole: str) -> Column:
    m = F.col("_m")
    return m[part] / F.greatest(m[whole], F.lit(1))


# name, what is measured, when it is bad, when it is good; neither: the rule abstains
RULES: tuple[tuple[str, Callable[[], Column], Callable, Callable], ...] = (
    ("length", lambda: F.col("_m.n_words"), lambda x: x < 20, lambda x: x >= 100),
    ("symbols", lambda: _share("n_symbols", "n_words"), lambda x: x > 0.2, lambda x: x < 0.05),
    ("symbol share", lambda: _share("n_symbols", "word_chars"), lambda x: x > 0.05, lambda x: x < 0.01),
    ("repeats", lambda: _share("n_repeat_words", "n_words"), lambda x: x > 0.3, lambda x: x < 0.1),
    ("lines", lambda: _share("n_dup_lines", "n_lines"), lambda x: x > 0.5, lambda x: x < 0.1),
    ("capitals", lambda: _share("n_upper", "n_letters"), lambda x: x > 0.5, lambda x: x < 0.2),
    ("letters", lambda: _share("n_letters", "word_chars"), lambda x: x < 0.7, lambda x: x > 0.85),
    ("word size", lambda: _share("word_chars", "n_words"),
     lambda x: (x < 2) | (x > 20), lambda x: (x > 2.5) & (x < 12)),
    ("stops", lambda: _share("n_stops", "n_words"),
     lambda x: (x > 0.5) | (x < 0.001), lambda x: (x > 0.01) & (x < 0.3)),
)


def votes() -> Column:
    """One vote a rule: 1 good, -1 bad, 0 none."""
    return F.array(*(
        F.when(bad(measure()), F.lit(-1)).when(good(measure()), F.lit(1)).otherwise(F.lit(0))
        for _, measure, bad, good in RULES
    ))


@dataclass(frozen=True)
class VoteModel:
    """``good``: share of good texts. Per rule, the chance of the right vote when it votes."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def log_odds(self, rule: int, vote: int) -> float:
        g, b = self.right_on_good[rule], self.right_on_bad[rule]
        return {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0}[vote]

    def posterior(self, votes: Column) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for i in range(len(self.right_on_good)):
            vote = F.get(votes, i)
            total = total + F.when(vote == 1, self.log_odds(i, 1)).when(
                vote == -1, self.log_odds(i, -1)
            ).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_votes(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from rules that seldom accuse good texts and of which a bad text breaks few. A rule is held to be no worse than
    chance, so good and bad can't change places. Without texts the start values stay.
    """
    rules = len(RULES)
    model = VoteModel(0.7, (0.99,) * rules, (0.3,) * rules)
    for _ in range(rounds if patterns else 0):
        total = good = 0.0
        hit = [[1.0, 1.0] for _ in range(rules)]  # right votes on good, on bad; smoothed
        cast = [[2.0, 2.0] for _ in range(rules)]
        for pattern, n in patterns.items():
            odds = math.log(model.good / (1 - model.good))
            odds += sum(model.log_odds(i, v) for i, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            total, good = total + n, good + n * p
            for i, v in enumerate(pattern):
                if v:
                    cast[i][0] += n * p
                    cast[i][1] += n * (1 - p)
                    hit[i][0] += n * p * (v > 0)
                    hit[i][1] += n * (1 - p) * (v < 0)

        def share(i: int, side: int, least: float) -> float:
            return min(0.9999, max(least, hit[i][side] / cast[i][side]))

        model = VoteModel(
            min(0.99, max(0.5, good / total)),
            tuple(share(i, 0, 0.5) for i in range(rules)),
            tuple(max(share(i, 1, 0.0), 1 - share(i, 0, 0.5)) for i in range(rules)),
        )
    return model


def fit(rows: DataFrame) -> VoteModel:
    """The model of all rows of :func:`measured`."""
    counted = rows.select(votes().alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    return fit_votes({tuple(r["votes"]): r["n"] for r in counted.collect()})


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def kept(model: VoteModel) -> Column:
    return ~base_failed() & (model.posterior(votes()) >= 0.5)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``probability`` and ``kept`` of every row.

    Null and empty texts have no words and fail. Repeated rows are judged alike, each in its
    own row; null ids are kept; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = write_once(measured(source).drop("text"))
    model = fit(rows)
    return rows.select(
        "doc_id", "_m.*", base_failed().alias("base_failed"),
        model.posterior(votes()).alias("probability"), kept(model).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    # whole rows as one column, so that no name of theirs can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = measured(docs.select(row, F.col(text_col).alias("text")))
    # measured once: the model needs all votes before the first row can be judged
    rows = write_once(rows.select("row", "_m"))
    return rows.filter(kept(fit(rows))).select("row.*")
