"""Dedup, conflicts, sampling, ranking, features and evaluation on small inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textprep import functions as fn
from textprep.operators import dedup, evaluate, profile, ranking, sampling, sequences, tfidf, weights


# ---- dedup ------------------------------------------------------------------------

ROWS = [
    (0, 0, "a", 1), (0, 1, "b", 1), (1, 0, "a", 1), (1, 1, "b", 0), (1, 2, "c", 0),
    (1, 3, None, 0), (1, 4, None, 0),
]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame(ROWS, "source_rank int, id bigint, text string, label int")


@pytest.mark.parametrize("packed", [True, False])
def test_keep_first_prefers_the_earlier_source(labelled, packed):
    order = fn.row_order("source_rank", "id") if packed else ("source_rank", "id")
    got = {tuple(r) for r in dedup.keep_first(labelled, "text", order).collect()}
    assert got == {ROWS[0], ROWS[1], ROWS[4], ROWS[5]}


def test_resolve_drops_conflicts_before_dedup(labelled):
    got = {tuple(r) for r in dedup.resolve(labelled, "text").collect()}
    assert got == {ROWS[0], ROWS[4], ROWS[5]}


def test_conflict_steps_agree_with_one_aggregate(labelled):
    steps = dedup.keep_first(dedup.drop_conflicts(labelled, "text"), "text")
    assert set(steps.collect()) == set(dedup.resolve(labelled, "text").collect())
    assert [tuple(r) for r in dedup.conflict_groups(labelled, "text").collect()] == [("b", 2, 2)]


def test_duplicate_members(labelled):
    got = {(r["source_rank"], r["id"]) for r in dedup.duplicate_members(labelled, "text").collect()}
    assert got == {(0, 0), (1, 0), (0, 1), (1, 1), (1, 3), (1, 4)}
    assert dedup.count_duplicate_members(labelled, "text").first()["n"] == 6


def test_string_labels(spark):
    df = spark.createDataFrame(
        [(0, 0, "x", "sarcastic"), (1, 0, "x", "plain"), (1, 1, "y", "plain")],
        "source_rank int, id bigint, text string, label string",
    )
    assert [r["text"] for r in dedup.resolve(df, "text").collect()] == ["y"]


def test_unused_columns_leave_the_plan(labelled):
    plan = dedup.resolve(labelled, "text").select("label")._jdf.queryExecution().optimizedPlan()
    assert "min_by" not in plan.toString()


# ---- sampling ---------------------------------------------------------------------


def key(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def ranks(labels, seed):
    by = defaultdict(list)
    for i, c in labels:
        by[c].append(i)
    return {
        i: (c, r) for c, ids in by.items()
        for r, i in enumerate(sorted(ids, key=lambda i: key(seed, i)), 1)
    }


@pytest.fixture
def classes(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["a", "b", "c"], [70, 25, 5])[0]) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "id bigint, label string").repartition(7)


@pytest.mark.parametrize("per_prefix", [50_000, 20])
def test_split_folds_undersample_exact(classes, monkeypatch, per_prefix):
    monkeypatch.setattr(sampling, "ROWS_PER_PREFIX", per_prefix)
    rows, df = classes
    rank, sizes = ranks(rows, 42), Counter(c for _, c in rows)
    quota = sampling.largest_remainder(dict(sizes), math.ceil(len(rows) * 0.3))
    assert sum(quota.values()) == 1500

    split = {r["id"]: r["split"] for r in sampling.stratified_split(df, 0.3, 42).collect()}
    assert split == {i: "test" if r <= quota[c] else "train" for i, (c, r) in rank.items()}

    low = min(sizes.values())
    under = {r["id"] for r in sampling.undersample(df, 42).collect()}
    assert under == {i for i, (c, r) in rank.items() if r <= low}

    folds = sampling.stratified_folds(df, 5, 42).collect()
    assert len(folds) == len(rows)
    for c in sizes:
        per = Counter(r["fold"] for r in folds if r["label"] == c)
        assert set(per) == set(range(5)) and max(per.values()) - min(per.values()) <= 1


def test_tiny_and_single_classes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id bigint, label int")
    folds = {r["id"]: r["fold"] for r in sampling.stratified_folds(df, 5, 1).collect()}
    assert set(folds) == {1, 2, 3} and all(0 <= f < 5 for f in folds.values())
    one = df.filter("label = 0")
    split = Counter(r["split"] for r in sampling.stratified_split(one, 0.5, 1).collect())
    assert split == {"test": 1, "train": 1}
    assert sampling.undersample(df, 1).count() == 2


def test_null_label_is_kept_in_train(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "id bigint, label int")
    got = {r["id"]: r["split"] for r in sampling.stratified_split(df, 0.9, 1).collect()}
    assert len(got) == 3 and got[2] == "train"


# ---- ranking and sequences --------------------------------------------------------


def test_global_rank_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(f"w{i}", 1 if i % 3 else rng.randrange(50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "term string, tf int").repartition(9)
    ranked = ranking.global_rank(df, [F.desc("tf"), F.asc("term")])
    want = {t: r for r, (t, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert {r["term"]: r["idx"] for r in ranked.collect()} == want


def test_vocabulary_ties_and_cap(spark):
    df = spark.createDataFrame([(1, ["b", "a", "c", "c"]), (2, ["d"])], "id int, t array<string>")
    full = {r["term"]: r["idx"] for r in sequences.fit_vocabulary(df, "t").collect()}
    assert full == {"c": 1, "a": 2, "b": 3, "d": 4}
    capped = sequences.fit_vocabulary(df, "t", num_words=3)
    assert {r["term"]: r["idx"] for r in capped.collect()} == {"c": 1, "a": 2}
    oov = sequences.fit_vocabulary(df, "t", num_words=4, oov=True)
    assert {r["term"]: r["idx"] for r in oov.collect()} == {"c": 2, "a": 3}


def test_encode(spark):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "term string, idx int")
    df = spark.createDataFrame(
        [(1, ["b", "x", "a", "b"]), (2, []), (3, ["x"]), (4, None)], "id int, t array<string>"
    )
    plain = {r["id"]: r["seq"] for r in sequences.encode(df, "t", vocab, ["id"], 10).collect()}
    assert plain == {1: [3, 2, 3], 2: [], 3: [], 4: []}
    cut = {r["id"]: r["seq"] for r in sequences.encode(df, "t", vocab, ["id"], 3).collect()}
    assert cut == {1: [2], 2: [], 3: [], 4: []}
    oov = sequences.encode(df, "t", vocab, ["id"], None, oov=True).collect()
    assert {r["id"]: r["seq"] for r in oov} == {1: [3, 1, 2, 3], 2: [], 3: [1], 4: []}


def test_encode_by_dictionary(spark):
    """Any vocabulary, words repeated and unknown, rows of no tokens and of none at all."""
    rows = [(i, random.Random(i).choices("abcdefgh", k=i % 7)) for i in range(40)] + [(99, None), (98, ["zz", "a"])]
    docs = spark.createDataFrame(rows, "id int, t array<string>").repartition(4)
    vocab = sequences.fit_vocabulary(docs.filter("id < 90"), "t")
    ids = {r["term"]: r["idx"] for r in vocab.collect()}
    for oov in (False, True):
        got = {r["id"]: r["seq"] for r in sequences.encode(docs, "t", vocab, ["id"], oov=oov).collect()}
        want = {i: [ids.get(w, 1) if oov else ids[w] for w in t or [] if oov or w in ids] for i, t in rows}
        assert got == want


@pytest.mark.parametrize("n", [0, 2, 3, 4])
def test_pad(spark, n):
    df = spark.createDataFrame([(list(range(1, n + 1)),)], "s array<int>")
    row = df.select(
        sequences.pad("s", 3, "post", "pre"), sequences.pad("s", 3, "post", "post"),
        sequences.pad("s", 3, "pre", "pre"),
    ).first()
    s = list(range(1, n + 1))
    zeros = [0] * max(3 - n, 0)
    assert [list(x) for x in row] == [s[-3:] + zeros, s[:3] + zeros, zeros + s[-3:]]


def test_missing_vectors(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, idx int")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("z", [9.0, 9.0])], "term string, vector array<float>")
    zeros = sequences.embedding_table(vocab, vec, 2, num_words=3).collect()
    assert {r["term"]: r["vector"] for r in zeros} == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    big = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("term"), F.col("id").cast("int").alias("idx"))
    drawn = sequences.embedding_table(big, vec, 5, missing="normal", seed=3)
    values = np.array([r["vector"] for r in drawn.collect()]).ravel()
    assert abs(values.mean()) < 0.03 and abs(values.std() - 0.6) < 0.03
    again = sequences.embedding_table(big.repartition(3), vec, 5, missing="normal", seed=3)
    assert set(map(str, again.collect())) == set(map(str, drawn.collect()))


# ---- TF-IDF -----------------------------------------------------------------------


@pytest.fixture
def corpus(spark):
    rng = random.Random(3)
    docs = [(i, rng.randrange(2), [f"t{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(0, 30))])
            for i in range(120)]
    return docs, spark.createDataFrame(docs, "id bigint, label int, t array<string>").repartition(5)


def brute_tfidf(docs, min_df, max_df, cap):
    n = len(docs)
    df = Counter(t for _, _, ts in docs for t in set(ts))
    tf = Counter(t for _, _, ts in docs for t in ts)
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * n), key=lambda t: (-tf[t], t))[:cap]
    out = {}
    for i, _, ts in docs:
        w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1)
             for t, c in Counter(ts).items() if t in kept}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return kept, out


def test_counting_inside_the_row(spark, corpus):
    docs, df = corpus
    got = Counter({(r["id"], r["term"]): r["tf"] for r in tfidf.term_counts(df, "t", ["id"]).collect()})
    assert got == Counter((i, t) for i, _, ts in docs for t in ts)


@pytest.mark.parametrize("cap", [8, None])
def test_tfidf_and_chi2(spark, corpus, cap):
    docs, df = corpus
    kept, want = brute_tfidf(docs, 5, 0.6, cap)
    counts = tfidf.term_counts(df, "t", ["id", "label"])
    n = tfidf.document_total(df)
    vocab = tfidf.df_bounds(tfidf.term_stats(counts), n, 5, 0.6)
    if cap:
        vocab = tfidf.cap_vocabulary(vocab, cap)
    weighted = tfidf.tfidf_weights(counts, vocab, n, ["id", "label"], cap)
    got = {(r["id"], r["term"]): r["weight"] for r in weighted.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)

    inside = tfidf.weigh_documents(df, "t", vocab, n, ["id", "label"], cap or 1_000)
    assert inside.columns == weighted.columns
    same = {(r["id"], r["term"]): r["weight"] for r in inside.collect()}
    assert same.keys() == want.keys() and all(abs(same[k] - want[k]) < 1e-9 for k in want)

    label = {i: c for i, c, _ in docs}
    share = {c: m / len(docs) for c, m in Counter(label.values()).items()}
    scores = {}
    for t in kept:
        o = {c: sum(w for (i, u), w in want.items() if u == t and label[i] == c) for c in share}
        scores[t] = sum((o[c] - share[c] * sum(o.values())) ** 2 / (share[c] * sum(o.values())) for c in share)
    chi2 = tfidf.chi2_scores(weighted, sampling.class_sizes(df))
    found = {r["term"]: r["chi2"] for r in chi2.collect()}
    assert found.keys() == scores.keys()
    assert all(abs(found[t] - scores[t]) < 1e-9 for t in scores)
    if cap:  # a vocabulary beyond the stated size is not cut, it goes another way
        other = tfidf.tfidf_weights(counts, vocab, n, ["id", "label"], 2)
        assert {(r["id"], r["term"]) for r in other.collect()} == want.keys()
        other = tfidf.weigh_documents(df, "t", vocab, n, ["id", "label"], 2)
        assert {(r["id"], r["term"]) for r in other.collect()} == want.keys()
    best = [r["term"] for r in tfidf.select_k_best(chi2, 3).collect()]
    assert set(best) == set(sorted(scores, key=lambda t: (-scores[t], t))[:3])
    kept_rows = tfidf.project_terms(weighted, chi2.filter(F.col("term").isin(best)), 3)
    assert {r["term"] for r in kept_rows.collect()} == set(best)


def test_df_bounds_are_inclusive(spark):
    docs = spark.createDataFrame([(i, ["x"] * (i < 3) + ["y"] * (i < 2)) for i in range(4)], "id int, t array<string>")
    stats = tfidf.term_stats(tfidf.term_counts(docs, "t", ["id"]))
    assert {r["term"] for r in tfidf.df_bounds(stats, 4, 2, 0.75).collect()} == {"x", "y"}
    assert {r["term"] for r in tfidf.df_bounds(stats, 4, 3, 0.75).collect()} == {"x"}
    assert {r["term"] for r in tfidf.df_bounds(stats, 4, 1, 0.74).collect()} == {"y"}


@pytest.mark.parametrize("cells", [64, 1 << 20])
@pytest.mark.parametrize("bounds", [(1, 1.0), (2, 0.5), (7, 0.9), (300, 1.0)])
def test_bounded_terms_are_exact(spark, cells, bounds):
    """Terms that share cells, rows of no tokens, and bounds beyond a byte."""
    drawn = random.Random(3)
    rows = [(i, [f"t{int(drawn.paretovariate(0.4)) % 500}" for _ in range(i % 12)]) for i in range(600)]
    docs = spark.createDataFrame([*rows, (700, None), (701, ["x"] * 9)], "id int, t array<string>").repartition(4)
    want = tfidf.df_bounds(tfidf.term_stats(tfidf.term_counts(docs, "t", ["id"])), 602, *bounds)
    found = tfidf.bounded_terms(docs, "t", 602, *bounds, cells=cells)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


# ---- profile, weights, evaluation -------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([(0,), (0,), (3,)], "label int")
    assert [tuple(r) for r in profile.dense_counts(df).orderBy("label").collect()] == [
        (0, 2), (1, 0), (2, 0), (3, 1),
    ]
    assert [r["label"] for r in profile.class_counts(df).collect()] == [0, 3]
    row = profile.positive_ratio(df.filter("label = 0")).first()
    assert tuple(row) == (0.0, "0.00%")


def test_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(50)], "id int, label int")
    found = weights.attach_weights(df, weights.balanced_weights(df))
    assert abs(found.agg(F.sum("weight")).first()[0] - 50) < 1e-9
    assert {r["label"]: r["weight"] for r in weights.ratio_weights(df).collect()} == {0: 1.0, 1: 9.0}


# Published reports: (TN, FP, FN, TP) and the figures printed for them.
REPORTS = [
    ((92, 40, 6, 14), "0.94 0.70 0.80 132 0.26 0.70 0.38 20 0.70 0.60 0.70 0.59 0.85 0.70 0.74"),
    ((111, 21, 11, 9), "0.91 0.84 0.87 132 0.30 0.45 0.36 20 0.79 0.60 0.65 0.62 0.83 0.79 0.81"),
    ((178, 10, 8, 31), "0.96 0.95 0.95 188 0.76 0.79 0.78 39 0.92 0.86 0.87 0.86 0.92 0.92 0.92"),
    ((186, 2, 2, 37), "0.99 0.99 0.99 188 0.95 0.95 0.95 39 0.98 0.97 0.97 0.97 0.98 0.98 0.98"),
    ((264, 1, 18, 37), "0.94 1.00 0.97 265 0.97 0.67 0.80 55 0.94 0.95 0.83 0.88 0.94 0.94 0.94"),
]


@pytest.mark.parametrize("matrix, printed", REPORTS)
def test_published_reports(spark, matrix, printed):
    tn, fp, fn_, tp = matrix
    cells = spark.createDataFrame(
        [(0, 0, tn), (0, 1, fp), (1, 0, fn_), (1, 1, tp)], "label int, prediction int, n bigint"
    )
    cells = evaluate.confusion_cells(cells, n="n")
    report = {r["class"]: r for r in evaluate.classification_report(cells, {0: "no", 1: "yes"}).collect()}
    out = []
    for name in ("no", "yes"):
        r = report[name]
        out += [f"{r[m]:.2f}" for m in ("precision", "recall", "f1")] + [str(r["support"])]
    out.append(f"{report['accuracy']['f1']:.2f}")
    for name in ("macro avg", "weighted avg"):
        out += [f"{report[name][m]:.2f}" for m in ("precision", "recall", "f1")]
    assert " ".join(out) == printed
    assert report["accuracy"]["support"] == sum(matrix)


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label int, prediction int")
    matrix = evaluate.confusion_matrix(df, [0, 1]).collect()
    assert [tuple(r) for r in matrix] == [(0, 1, 0), (1, 2, 0)]
    metrics = {r["label"]: r for r in evaluate.class_metrics(evaluate.confusion_cells(df)).collect()}
    assert (metrics[1]["precision"], metrics[1]["recall"], metrics[1]["f1"]) == (0, 0, 0)
    assert evaluate.balanced_accuracy(df).first()[0] == 0.5
    assert tuple(evaluate.positive_metrics(df).first()) == (0.0, 0.0)


def test_confusion_cells_of_many_classes(spark):
    df = spark.range(2_000).select(F.col("id").alias("label"), F.floor(F.col("id") / 2).cast("long").alias("prediction"))
    cells = evaluate.confusion_cells(df)
    assert cells.count() == 4_000_000
    assert cells.agg(F.sum("n")).first()[0] == 2_000


def test_confusion_matrix_loses_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "label int, prediction int")
    with pytest.raises(Exception, match="no column for the predicted class 2"):
        evaluate.confusion_matrix(df, [0, 1]).collect()
    assert evaluate.confusion_matrix(df, [0, 1, 2]).count() == 3


def test_dense_counts_have_a_bound(spark):
    df = spark.createDataFrame([(1_000_000_000,)], "label int")
    with pytest.raises(Exception, match="a label is over"):
        profile.dense_counts(df).collect()


def test_slices_hold_every_row_once():
    """Pieces end between rows, a longer row is one of its own, and numbering starts anew."""
    lists = [["a"] * n if n is not None else None for n in (3, 0, None, 12, 1, 4, 5, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["id", "t"])
    pieces = list(tfidf.slicer("t", 5)([batch, batch.slice(0, 0), batch.slice(3)]))
    assert [r["id"] for p in pieces for r in p.to_pylist()] == [*range(8), *range(3, 8)]
    assert [sum(len(t or []) for t in p.column("t").to_pylist()) for p in pieces[:4]] == [3, 12, 5, 5]
    assert all(p.num_rows == 1 or sum(len(t or []) for t in p.column("t").to_pylist()) <= 5 for p in pieces)


def test_counts_and_weights_in_slices(spark, monkeypatch):
    """The size of a piece changes no sketch, count or weight."""
    drawn = random.Random(12)
    docs = [(i, [f"t{drawn.randrange(9)}" for _ in range(drawn.randrange(8))]) for i in range(50)]
    df = spark.createDataFrame([*docs, (50, None)], "id int, t array<string>").coalesce(1)
    stats, found = [], []
    make = tfidf.slicer
    for most in (100_000, 3):
        monkeypatch.setattr(tfidf, "slicer", lambda c, most=most: make(c, most))
        kept = tfidf.bounded_terms(df, "t", 51, 2, 0.9, cells=1 << 10)
        stats.append(sorted(map(tuple, kept.collect())))
        weighed = tfidf.weigh_documents(df, "t", kept, 51, ["id"], 20)
        found.append(sorted((r["id"], r["term"], round(r["weight"], 12)) for r in weighed.collect()))
    plain = tfidf.df_bounds(tfidf.term_stats(tfidf.term_counts(df, "t", [])), 51, 2, 0.9)
    assert stats[0] == stats[1] == sorted(map(tuple, plain.collect()))
    assert found[0] == found[1] and found[0]
