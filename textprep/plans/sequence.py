"""Id sequences, word vectors and a sigmoid unit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from textprep.functions.cleaners import punct_lower, script_letters, script_only, word_basic
from textprep.functions.scalars import as_text
from textprep.functions.text import SEQUENCE_FILTERS
from textprep.models.stages import PadSequence, SequenceTokens, Vocabulary
from textprep.models.vectors import word2vec_classifier
from textprep.operators.dedup import Order, keep_first, resolve
from textprep.operators.rows import drop_blank, drop_null
from textprep.session import stable


@dataclass(frozen=True)
class SequenceSettings:
    """How a sequence model reads text.

    ``repeats`` says what happens to equal texts: ``raw`` keeps the first of equal raw
    texts, ``conflict`` drops cleaned texts with contradicting labels and keeps the first of
    the others, ``none`` keeps all rows.
    """

    num_words: int
    length: int
    oov: bool
    padding: str
    truncating: str
    cleaner: Callable[..., Column]
    repeats: str
    filters: str = SEQUENCE_FILTERS


# Sequence settings of the published models.
GRU = SequenceSettings(12_000, 35, True, "post", "pre", script_letters, "raw")
LSTM = SequenceSettings(15_000, 50, True, "post", "pre", punct_lower, "none", filters="")
VECTOR_LSTM = SequenceSettings(20_000, 100, False, "post", "post", word_basic, "conflict")
VECTOR_GRU = SequenceSettings(8_000, 35, True, "post", "pre", script_only, "none")
FROZEN_LSTM = SequenceSettings(15_000, 64, False, "pre", "pre", word_basic, "conflict")


def prepare(
    df: DataFrame,
    settings: SequenceSettings = GRU,
    marks: str = "keep",
    order: Order = ("source_rank", "id"),
) -> DataFrame:
    """Drop nulls, clean, drop what became blank, and treat repeats as ``settings`` say."""
    if settings.repeats not in ("raw", "conflict", "none"):
        raise ValueError("repeats must be 'raw', 'conflict' or 'none'")
    rows = drop_null(df)
    if settings.repeats == "raw":
        rows = keep_first(rows, "text", order)
    clean = settings.cleaner(as_text("text"), marks=marks)
    rows = drop_blank(rows.withColumn("clean_text", clean)).drop("text")
    return resolve(rows, "clean_text", order=order) if settings.repeats == "conflict" else rows


def sequence_stages(s: SequenceSettings, text: str = "clean_text") -> list:
    """Tokens, ids and padded ids; fit on the train part, apply to both."""
    return [
        SequenceTokens(inputCol=text, filters=s.filters),
        Vocabulary(numWords=s.num_words, oov=s.oov),
        PadSequence(length=s.length, padding=s.padding, truncating=s.truncating),
    ]


class _Words(SequenceTokens):
    """Ids back to words for the word-vector learner; fill ids go."""

    def expression(self, c):
        return F.transform(F.filter(c, lambda i: i > 0), lambda i: i.cast("string"))


def learned_vectors(s: SequenceSettings = GRU, **params) -> Pipeline:
    """Ids of whole texts, word vectors learned over the capped vocabulary, sigmoid unit.

    A mean over word vectors needs no fixed length, so nothing is cut or padded.
    """
    tokens, vocabulary, _ = sequence_stages(s)
    words = _Words(inputCol=vocabulary.getOutputCol(), outputCol="words")
    return Pipeline(stages=[tokens, vocabulary, words, word2vec_classifier("words", **params)])


def fit_learned_vectors(
    train: DataFrame, s: SequenceSettings = GRU, label: str = "label", **params
) -> PipelineModel:
    """:func:`learned_vectors` fitted, with the ids of ``train`` stored once.

    The learner reads its rows twice and the classifier twice more; texts are taken apart and
    looked up before that, not in each of these passes.
    """
    tokens, vocabulary, words, learner = learned_vectors(s, label=label, **params).getStages()
    first = Pipeline(stages=[tokens, vocabulary]).fit(train)
    kept = stable(first.transform(train).select(label, vocabulary.getOutputCol()))
    last = Pipeline(stages=[words, learner]).fit(kept)
    return PipelineModel([*first.stages, *last.stages])
