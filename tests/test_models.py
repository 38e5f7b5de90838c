"""Feature stages, classifiers and the search, on data with a known answer."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from test_operators import brute_tfidf
from textprep.functions import sequence_tokens, word_tokens
from textprep.models import classifiers
from textprep.models import (
    BalancedAccuracyEvaluator,
    Chi2Selector,
    Cleaner,
    MarginSVC,
    PadSequence,
    PlattSVC,
    SequenceTokens,
    SharedFeatures,
    TfidfVectors,
    Vocabulary,
    WordTerms,
    balanced_forest,
    best_parameters,
    cooccurrence_vectors,
    grid,
    mean_vectors,
    perceptron,
    sample_rows,
    score_batches,
    search,
    search_forests,
    weighted_logistic,
)
from textprep.models import cooccurrence
from textprep.operators import sampling, sequences, tfidf
from textprep.operators.evaluate import balanced_accuracy
from textprep.plans import classical, conflict, sequence


@pytest.fixture(scope="module")
def texts(spark):
    """Label 1 is one text in six and tells itself by a few words."""
    rng = random.Random(5)
    hindi = str.maketrans("0123456789", "०१२३४५६७८९")
    common = [f"शब्द{i}".translate(hindi) for i in range(40)]
    marked = [f"व्यंग्य{i}".translate(hindi) for i in range(6)]
    rows = []
    for i in range(360):
        label = int(i % 6 == 0)
        words = rng.choices(common, k=12) + rng.choices(marked if label else common, k=4)
        rng.shuffle(words)
        rows.append((i, 1 - label, " ".join(words) + "!", label))
    df = spark.createDataFrame(rows, "id bigint, source_rank int, text string, label int")
    return df.repartition(4).cache()


FEATURES = classical.TermFeatures(max_features=200, min_df=3, max_df=0.9, k=60)


@pytest.fixture(scope="module")
def parts(spark, texts):
    train, test = classical.split_and_fold(classical.prepare(texts), 0.25, folds=3)
    return train.cache(), test.cache()


def test_tfidf_stage_equals_the_definition(spark):
    rng = random.Random(6)
    docs = [(i, 0, [f"t{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]) for i in range(60)]
    df = spark.createDataFrame([(i, ts) for i, _, ts in docs], "id bigint, terms array<string>")
    kept, want = brute_tfidf(docs, 2, 0.5, 6)
    model = TfidfVectors(minDF=2, maxDF=0.5, maxFeatures=6).fit(df)
    order = sorted(kept)
    for row in model.transform(df).select("id", vector_to_array("tfidf").alias("v")).collect():
        for t, x in zip(order, row["v"]):
            assert abs(x - want.get((row["id"], t), 0.0)) < 1e-9


def test_tfidf_stage_without_terms(spark):
    df = spark.createDataFrame([(["a"],), (["b"],)], "terms array<string>")
    with pytest.raises(ValueError, match="no terms"):
        TfidfVectors(minDF=2).fit(df)


def test_chi2_stage(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((50, 5)) * (rng.random((50, 5)) > 0.5), rng.integers(0, 2, 50)
    x[:, 3] = 0
    df = spark.createDataFrame(
        [(v.tolist(), int(c)) for v, c in zip(x, y)], "a array<double>, label int"
    ).select(array_to_vector("a").alias("tfidf"), "label")
    observed = np.array([x[y == c].sum(0) for c in (0, 1)])
    expected = np.outer(np.bincount(y) / 50, x.sum(0))
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(((observed - expected) ** 2 / expected).sum(0))
    assert np.allclose(Chi2Selector().scores(df), want)
    slicer = Chi2Selector(k=2).fit(df)
    assert list(slicer.getIndices()) == sorted(np.argsort(-want, kind="stable")[:2])
    assert len(Chi2Selector(k=99).fit(df).getIndices()) == 5


@pytest.mark.parametrize("oov", [True, False])
def test_vocabulary_stage_equals_the_join(spark, texts, oov):
    df = texts.select("id", sequence_tokens("text").alias("tokens"))
    df = df.union(spark.createDataFrame([(9999, []), (9998, None)], df.schema))
    vocab = sequences.fit_vocabulary(df, "tokens", 20, oov)
    joined = sequences.encode(df, "tokens", vocab, ["id"], 20, oov)
    model = Vocabulary(numWords=20, oov=oov).fit(df)
    assert {r["id"]: r["seq"] for r in model.transform(df).collect()} == {
        r["id"]: r["seq"] for r in joined.collect()
    }


def test_svm_objective(spark):
    """The weights found minimise the textbook objective: no small step improves it."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(scale=1.0, size=200) > 1.0).astype(int)
    df = spark.createDataFrame(
        [(v.tolist(), int(c)) for v, c in zip(x, y)], "a array<double>, label int"
    ).select(array_to_vector("a").alias("features"), "label").coalesce(1)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))

    def objective(w, b, c):
        hinge = np.maximum(0, 1 - (2 * y - 1) * (x @ w + b))
        return 0.5 * w @ w + c * (weight * hinge).sum()

    for c in (0.1, 1.0):
        m = MarginSVC(C=c, maxIter=100).fit(df)
        w, b = m.coefficients.toArray(), m.intercept
        best = objective(w, b, c)
        steps = [objective(w + rng.normal(scale=0.05, size=3), b + rng.normal(scale=0.05), c)
                 for _ in range(300)]
        assert best <= min(steps) * 1.002
        other = LinearSVC(standardization=False, regParam=1.0 / c, maxIter=50).fit(df)
        assert best < objective(other.coefficients.toArray(), other.intercept, c)


def test_svm_search_and_persistence(spark, parts, tmp_path):
    train, test = parts
    pipeline, maps = classical.svm(FEATURES, maxIter=6)
    assert len(maps) == 4
    found = classical.run_search(pipeline, maps, train, folds=3)
    chosen, score = best_parameters(found)
    assert set(chosen) == {"C"} and score > 0.9
    accuracy, cells = classical.evaluate(found.bestModel, train, test)
    assert {r["split"]: r["accuracy"] > 0.9 for r in accuracy.collect()} == {"train": True, "test": True}
    assert cells.agg(F.sum("n")).first()[0] == test.count()
    path = str(tmp_path / "model")
    found.bestModel.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(test).select("id", "prediction")
    assert set(again.collect()) == set(found.bestModel.transform(test).select("id", "prediction").collect())


class CountingTfidf(TfidfVectors):
    fits = 0

    def _fit(self, dataset):
        CountingTfidf.fits += 1
        return super()._fit(dataset)


def test_features_are_fitted_once_per_fold(parts):
    train, _ = parts
    svc = MarginSVC(maxIter=2)
    stages = [WordTerms(), CountingTfidf(minDF=3, maxFeatures=100), Chi2Selector(k=20), svc]
    search(SharedFeatures(stages=stages), grid(svc, {"C": [0.1, 1.0, 10.0]}), train, folds=3)
    assert CountingTfidf.fits == 3 + 1  # one per fold, one for the final model


def test_a_search_takes_terms_apart_once(parts, monkeypatch):
    """Not once a fold; scores and the best model are those of a search that does."""
    train, _ = parts
    sketches, sketch = [], tfidf.sketch
    monkeypatch.setattr(tfidf, "sketch", lambda *a, **k: sketches.append(a) or sketch(*a, **k))
    svc = MarginSVC(maxIter=2)
    stages = [WordTerms(), TfidfVectors(minDF=3, maxDF=0.7, maxFeatures=40), Chi2Selector(k=20), svc]
    maps = grid(svc, {"C": [0.1, 1.0]})
    shared = search(SharedFeatures(stages=stages), maps, train, folds=3)
    assert len(sketches) == 1
    plain = search(Pipeline(stages=stages), maps, train, folds=3)
    assert shared.avgMetrics == pytest.approx(plain.avgMetrics)
    a, b = ([s for m in x.bestModel.stages for s in getattr(m, "stages", [m])] for x in (shared, plain))
    assert a[1].vocabulary == b[1].vocabulary
    assert a[2].getOrDefault("idf") == pytest.approx(b[2].getOrDefault("idf"), rel=1e-14)
    assert a[3].getIndices() == b[3].getIndices()


def test_solver_steps_need_no_exchange(spark, monkeypatch):
    """Rows that are kept already are not kept again, and a step's sums need one stage."""
    monkeypatch.setattr(classifiers, "ROWS_A_TASK", 10)
    rows = spark.range(200).repartition(20).persist()
    assert rows.count() == 200
    with classifiers.held(rows) as kept:
        assert kept.rdd.getNumPartitions() == 5
    assert rows.storageLevel.useMemory
    assert [classifiers.solver_tasks(n) for n in (5, 30, 499_999, 2_000_000)] == [1, 3, 5, 20]
    rows.unpersist()


@pytest.mark.parametrize("least", [1, 2])
def test_counts_fit_as_terms_do(spark, least):
    """On all rows and on those of every fold's training part; rows without a fold count too."""
    draw = random.Random(3)
    docs = [(i, draw.choice([0, 1, 2, None]), [f"t{min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.randrange(15))]) for i in range(80)]
    df = spark.createDataFrame(docs, "id int, fold int, terms array<string>").repartition(3)
    plain = TfidfVectors(minDF=least, maxDF=0.3, maxFeatures=20)
    stage, rows = plain.counted(df, "fold", 3)
    assert rows.columns == ["id", "fold", "terms"]
    for seen in (F.lit(True), *(~F.col("fold").eqNullSafe(i) for i in range(3))):
        want, got = plain.fit(df.filter(seen)), stage.fit(rows.filter(seen))
        assert got.of_terms.stages[0].vocabulary == want.stages[0].vocabulary
        idf = want.stages[1].getOrDefault("idf")
        assert got.of_terms.stages[1].getOrDefault("idf") == pytest.approx(idf, rel=1e-14)
        a = {r["id"]: r["tfidf"] for r in want.transform(df).select("id", "tfidf").collect()}
        b = {r["id"]: r["tfidf"] for r in got.transform(rows).select("id", "tfidf").collect()}
        assert a.keys() == b.keys()
        assert all(a[k].size == b[k].size and np.allclose(a[k].toArray(), b[k].toArray()) for k in a)


def test_probability_follows_the_margin(parts):
    train, test = parts
    model = classical.svm_with_probability(FEATURES, folds=3, maxIter=6).fit(train)
    rows = model.transform(test).select(
        vector_to_array("margin")[0].alias("m"), vector_to_array("probability")[1].alias("p")
    ).collect()
    rows.sort(key=lambda r: r["m"])
    p = [r["p"] for r in rows]
    assert all(0 <= x <= 1 for x in p) and all(a <= b + 1e-12 for a, b in zip(p, p[1:]))


def test_forest_grid_reaches_the_inner_classifier(parts):
    train, test = parts
    pipeline, maps = classical.forest(FEATURES, values={"numTrees": [3, 7], "maxDepth": [4]})
    models = [m for _, m in sorted(pipeline.fitMultiple(train, maps), key=lambda x: x[0])]
    assert [m.stages[-1].getNumTrees for m in models] == [3, 7]
    forest = classical.forest(FEATURES, numTrees=30, maxDepth=8)[0].fit(train)
    assert BalancedAccuracyEvaluator().evaluate(forest.transform(test)) > 0.8
    assert len(classical.forest()[1]) == 8


def test_mean_vectors(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0])], "term string, vector array<float>")
    df = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["x"]), (3, [])], "id int, t array<string>")
    for limit in (10, 1):  # below and above the size of the table
        rows = mean_vectors(df, "t", table, ["id"], 2, limit).collect()
        assert {r["id"]: list(r["features"]) for r in rows} == {1: [2.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_mean_vectors_of_large_tables(spark):
    """Copies of a term count each, rows of one key are one document, and words beyond the room
    in a task are looked up apart."""
    draw = random.Random(8)
    table = [(f"w{i}", [float(i), draw.random(), -1.0]) for i in (*range(30), 3, 3, 29)]
    docs = [(i // 2, [f"w{min(draw.randrange(40), draw.randrange(40))}" for _ in range(draw.randrange(12))]) for i in range(40)]
    docs.append((99, None))
    want = {}
    for k in {k for k, _ in docs}:
        own = [d or [] for j, d in docs if j == k]
        hits = [v for d in own for w in d for t, v in table if t == w]
        n = max(len(hits) + len(own) - 1, 1)
        want[k] = np.sum([*hits, [0.0] * 3], axis=0) / n
    df = spark.createDataFrame(docs, "id int, t array<string>").repartition(3)
    words = spark.createDataFrame(table, "term string, vector array<double>")
    for limit, room in ((100, 1 << 20), (0, 1 << 20), (0, 10 * 24), (0, 0)):
        rows = mean_vectors(df, "t", words, ["id"], 3, limit, hot_bytes=room).collect()
        assert len(rows) == len(want)
        assert all(np.allclose(r["features"].toArray(), want[r["id"]]) for r in rows)


def test_mean_vectors_exchange_one_row_a_document(spark):
    """Vectors are added up before the exchange, no row a word is joined or sent."""
    df = spark.range(50).select("id", F.array(F.lit("a"), F.lit("b")).alias("t"))
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0])], "term string, vector array<float>")
    plan = mean_vectors(df, "t", table, ["id"], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan


def test_vector_classifiers(spark, texts):
    """Words carry a vector that tells the two kinds apart."""
    words = texts.select(F.explode(word_tokens("text")).alias("term")).distinct()
    table = words.select(
        "term", F.array(F.col("term").startswith("व्यंग्य").cast("float"), F.lit(1.0).cast("float")).alias("vector")
    )
    features = mean_vectors(texts, word_tokens("text"), table, ["id", "label"], 2, 100).cache()
    score = BalancedAccuracyEvaluator()
    assert score.evaluate(weighted_logistic(maxIter=50).fit(features).transform(features)) > 0.95
    ratio = weighted_logistic(scheme="ratio", maxIter=50).fit(features)
    assert score.evaluate(ratio.transform(features)) > 0.95
    net = perceptron([2, 4, 2], maxIter=60).fit(sampling.undersample(features, 1))
    assert score.evaluate(net.transform(features)) > 0.9


def test_learned_vectors(texts):
    rows = sequence.prepare(texts, sequence.GRU).cache()
    model = sequence.learned_vectors(sequence.GRU, dim=16, iterations=3, partitions=2, maxIter=20).fit(rows)
    assert BalancedAccuracyEvaluator().evaluate(model.transform(rows)) > 0.9


def test_learned_vectors_read_stored_ids(texts, monkeypatch):
    """The learner's passes do not take the texts apart again."""
    from pyspark.ml import Estimator
    from pyspark.ml.feature import SQLTransformer

    plans = []

    class Seen(Estimator):
        def _fit(self, dataset):
            plans.append(dataset._jdf.queryExecution().optimizedPlan().toString())
            return SQLTransformer(statement="SELECT *, size(words) AS n FROM __THIS__")

    monkeypatch.setattr(sequence, "word2vec_classifier", lambda *_, **__: Pipeline(stages=[Seen()]))
    rows = texts.withColumn("clean_text", F.col("text"))
    model = sequence.fit_learned_vectors(rows, sequence.GRU)
    assert len(plans) == 1 and "clean_text" not in plans[0] and "EvalPython" not in plans[0]
    assert model.transform(rows).filter("n > 0").count() == rows.count()



def test_sequence_stages(texts):
    stages = [Cleaner(preset="word_basic"), SequenceTokens(), Vocabulary(numWords=30, oov=True),
              PadSequence(length=10, padding="post")]
    out = Pipeline(stages=stages).fit(texts).transform(texts).select("padded").collect()
    assert all(len(r["padded"]) == 10 and all(0 <= i < 30 for i in r["padded"]) for r in out)


def test_batch_scoring(spark):
    def make():
        return lambda x: x.sum(axis=1) * len(x)

    df = spark.createDataFrame([([float(i), 1.0],) for i in range(10)], "v array<float>").coalesce(1)
    rows = df.select(score_batches(make, width=2, batch_size=4)("v").alias("s")).collect()
    size = [4] * 8 + [2] * 2
    assert [r["s"] for r in rows] == [(i + 1.0) * n for i, n in enumerate(size)]


def test_conflict_plan(spark):
    rows = [(0, 0, "@a व्यंग्य है!", 1), (1, 0, "व्यंग्य है", 0), (1, 1, "सादा", 0), (1, 2, None, 0)]
    df = spark.createDataFrame(rows, "source_rank int, id bigint, text string, label int")
    assert [r["clean_text"] for r in conflict.prepare(df).collect()] == ["सादा"]
    profile = conflict.class_profile(df).collect()
    assert [(r["label"], r["n"], r["share"]) for r in profile] == [(0, 1, 1.0)]
    assert math.isclose(sum(r["share"] for r in profile), 1.0)


def test_cooccurrence_vectors_are_the_plain_ones(spark):
    """Counts within a window, positive information, seeded directions; unknown words drop out."""
    drawn = random.Random(4)
    docs = [[drawn.choice("abcdefgh") * 2 for _ in range(drawn.randrange(9))] for _ in range(60)] + [None, ["rare", "aa"]]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t array<string>").repartition(3)
    tf = Counter(w for d in docs for w in d or [])
    terms = sorted(tf, key=lambda w: (-tf[w], w))[:6]
    n = Counter()
    for d in docs:
        known = [terms.index(w) for w in d or [] if w in terms]
        for i, a in enumerate(known):
            for b in known[i + 1 : i + 3]:
                n[a, b] += 1
                n[b, a] += 1
    own, total = Counter(), sum(n.values())
    for (a, _), k in n.items():
        own[a] += k
    want = {}
    for (a, b), k in n.items():
        p = math.log(k * total / (own[a] * own[b]))
        if p > 0:
            direction = np.random.default_rng([5, b]).standard_normal(12).astype(np.float32)
            want[a] = want.get(a, 0) + p * direction
    got = {r["term"]: np.array(r["vector"]) for r in cooccurrence_vectors(df, "t", 6, 12, 2, 5).collect()}
    assert got.keys() == {terms[a] for a in want}
    for a, v in want.items():
        assert np.allclose(got[terms[a]], v / np.linalg.norm(v), atol=1e-5)


def test_pairs_are_counted_once_in_bounded_steps(spark, monkeypatch):
    """Slices and flushes of a task change no count; a pair is sent one way round."""
    drawn = random.Random(9)
    docs = [[drawn.choice("abcdef") for _ in range(drawn.randrange(30))] for _ in range(40)]
    want = Counter()
    for d in docs:
        for i, a in enumerate(d):
            for b in d[i + 1 : i + 4]:
                want[a, b] += 1
                want[b, a] += 1
    df = spark.createDataFrame([(d,) for d in docs], "t array<string>").repartition(2)
    for step, pairs in ((250_000, 4_000_000), (7, 5), (1, 1)):
        monkeypatch.setattr(cooccurrence, "STEP", step)
        monkeypatch.setattr(cooccurrence, "PAIRS", pairs)
        once = cooccurrence.pair_counts(df, "t", list("abcdef"), 3).collect()
        assert all(r["w"] <= r["c"] for r in once)
        again = spark.createDataFrame(once, "w int, c int, n bigint")
        got = {("abcdef"[r["w"]], "abcdef"[r["c"]]): r["n"] for r in cooccurrence.both_ways(again).collect()}
        assert got == dict(want)


def test_sample_keeps_shares(spark):
    rows = spark.range(100).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    sample = sample_rows(rows, 40)
    assert Counter(r["label"] for r in sample.collect()) == {0: 32, 1: 8}
    again = sample_rows(rows.repartition(3), 40)
    assert sorted(r["id"] for r in sample.collect()) == sorted(r["id"] for r in again.collect())
    assert sample_rows(rows, 100) is rows


def test_forest_search_adds_up_trees(spark):
    """The smaller count is the forest of its trees, the larger one adds others to it."""
    drawn = random.Random(8)
    rows = [(i, drawn.random(), drawn.random(), i % 3) for i in range(90)]
    df = spark.createDataFrame(
        [(i, x, y, int(x + 0.3 * y > 0.6), f) for i, x, y, f in rows], "id int, x double, y double, label int, fold int"
    )
    stages = [VectorAssembler(inputCols=["x", "y"], outputCol="features")]
    found = search_forests(stages, df, {"numTrees": [5, 2], "maxDepth": [2, 4]}, folds=3)
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert {(r["numTrees"], r["maxDepth"]) for r in found} == {(2, 2), (5, 2), (2, 4), (5, 4)}
    assert found[0]["score"] > 0.8
    scores = []
    for fold in range(3):
        data = stages[0].transform(df)
        model = balanced_forest(numTrees=2, maxDepth=4).fit(data.filter(F.col("fold") != fold))
        scores.append(balanced_accuracy(model.transform(data.filter(F.col("fold") == fold))).first()[0])
    small = next(r["score"] for r in found if (r["numTrees"], r["maxDepth"]) == (2, 4))
    assert small == pytest.approx(sum(scores) / 3)


def test_tfidf_stage_counts_no_rare_terms(spark):
    """Fitting drops rare terms by the sketch, before terms are sorted or exchanged."""
    common = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([([*common, f"r{i}"],) for i in range(400)], "terms array<string>").repartition(2)
    seen = []
    made = tfidf.term_counts
    try:
        tfidf.term_counts = lambda *a: seen.append(a) or made(*a)
        model = TfidfVectors(minDF=2, maxDF=1.0, maxFeatures=10).fit(df)
    finally:
        tfidf.term_counts = made
    assert not seen and model.stages[0].vocabulary == common
