"""Term features and a linear or tree model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, functions as F

from textprep.functions.cleaners import script_strict
from textprep.functions.scalars import as_text
from textprep.models.classifiers import MarginSVC, PlattSVC, balanced_forest
from textprep.models.search import (
    FOREST_GRID, SVM_GRID, SharedFeatures, grid, search, search_forests,
)
from textprep.models.stages import Chi2Selector, TfidfVectors, WordTerms
from textprep.operators.dedup import Order, keep_first
from textprep.operators.evaluate import accuracy_by_split, confusion_cells
from textprep.operators.rows import min_length
from textprep.operators.sampling import stratified_folds, stratified_split
from textprep.session import stable


@dataclass(frozen=True)
class TermFeatures:
    """Vocabulary bounds and number of selected terms."""

    max_features: int
    min_df: int
    max_df: float
    k: int


# Feature settings of the two published models.
SVM_FEATURES = TermFeatures(max_features=3_000, min_df=7, max_df=0.75, k=1_500)
FOREST_FEATURES = TermFeatures(max_features=10_000, min_df=5, max_df=0.85, k=3_000)


def prepare(
    df: DataFrame,
    marks: str = "keep",
    min_chars: int = 10,
    order: Order = ("source_rank", "id"),
    **cleaner,
) -> DataFrame:
    """Clean, drop short texts, keep the first of equal cleaned texts."""
    clean = script_strict(as_text("text"), marks=marks, **cleaner)
    rows = min_length(df.withColumn("clean_text", clean).drop("text"), length=min_chars)
    return keep_first(rows, "clean_text", order)


def split_and_fold(df: DataFrame, test_fraction: float = 0.2, folds: int = 5, seed: int = 42):
    """``(train, test)``, the train part with folds.

    The prepared rows are written once; parts and folds are comparisons on top of that.
    """
    rows = stratified_split(stable(df, "id"), test_fraction, seed)
    train = stratified_folds(rows.filter("split = 'train'"), folds, seed)
    return train, rows.filter("split = 'test'")


def feature_stages(f: TermFeatures, text: str = "clean_text", marks: str = "keep") -> list:
    return [
        WordTerms(inputCol=text, marks=marks),
        TfidfVectors(minDF=f.min_df, maxDF=f.max_df, maxFeatures=f.max_features),
        Chi2Selector(k=f.k),
    ]


def svm(features: TermFeatures = SVM_FEATURES, marks: str = "keep", **params):
    """``(pipeline, parameter maps)`` of the support vector machine."""
    machine = MarginSVC(**params)
    stages = [*feature_stages(features, marks=marks), machine]
    return SharedFeatures(stages=stages), grid(machine, SVM_GRID)


def svm_with_probability(
    features: TermFeatures = SVM_FEATURES, marks: str = "keep", folds: int = 5, **params
) -> SharedFeatures:
    stages = [*feature_stages(features, marks=marks), PlattSVC(MarginSVC(**params), folds=folds)]
    return SharedFeatures(stages=stages)


def forest(
    features: TermFeatures = FOREST_FEATURES, marks: str = "keep", values=None, **params
):
    """``(pipeline, parameter maps)`` of the random forest, as deep as Spark grows them."""
    weighted = balanced_forest(**{"maxDepth": 30, **params})
    stages = [*feature_stages(features, marks=marks), weighted]
    maps = grid(weighted.classifier, FOREST_GRID if values is None else values)
    return SharedFeatures(stages=stages), maps


def evaluate(model: PipelineModel, train: DataFrame, test: DataFrame):
    """``(accuracy of train and test, confusion cells of test)``."""
    scored = [
        model.transform(part).select("label", F.col("prediction").cast("int").alias("prediction"),
                                     F.lit(name).alias("split"))
        for name, part in (("train", train), ("test", test))
    ]
    return accuracy_by_split(scored[0].union(scored[1])), confusion_cells(scored[1])


def run_forest_search(
    train: DataFrame, features: TermFeatures = FOREST_FEATURES, marks: str = "keep", **options
) -> list[dict]:
    """The published forest grid on rows that carry folds, see :func:`search_forests`; bound the
    rows with :func:`sample_rows` first."""
    return search_forests(feature_stages(features, marks=marks), train, **options)


def run_search(pipeline: Estimator, maps: list, train: DataFrame, folds: int = 5, **options):
    """Search on rows that carry folds."""
    return search(pipeline, maps, train, folds=folds, **options)
