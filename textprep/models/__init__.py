from textprep.models.classifiers import (
    ClassWeighted,
    MarginSVC,
    PlattSVC,
    balanced_forest,
    perceptron,
    weighted_logistic,
)
from textprep.models.cooccurrence import cooccurrence_vectors
from textprep.models.search import (
    FOREST_GRID,
    SVM_GRID,
    BalancedAccuracyEvaluator,
    SharedFeatures,
    best_parameters,
    grid,
    sample_rows,
    search,
    search_forests,
)
from textprep.models.stages import (
    Chi2Selector,
    Cleaner,
    PadSequence,
    SequenceTokens,
    TfidfVectors,
    TfidfWeights,
    Vocabulary,
    VocabularyModel,
    WordTerms,
)
from textprep.models.vectors import mean_vectors, score_batches, word2vec_classifier

__all__ = [n for n in dir() if not n.startswith("_")]
