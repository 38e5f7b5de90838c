"""Mixing, vector codes and whitening on small frames of odd rows, against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from textprep.llm import common, cover_tree, mixing, vector_codes, whitening
from textprep.llm.eigen import eigen

NAN, INF = float("nan"), float("inf")


# ---- mixing


def plain_targets(sizes, weights, share, epochs):
    """Clamp and hand on until none is above; ``sizes`` and ``weights`` by source."""
    cap = {s: epochs * n for s, n in sizes.items()}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * left / total >= cap[s]]
        if not over:
            break
        for s in over:
            out[s] = cap[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    for s in open_:
        out[s] = weights[s] * left / total
    return out


def plain_mix(rows, pattern, share, epochs, seed):
    """``(id, size, copies)`` of ``(id, source, text)``."""
    sized = [(i, s, len((t or "").split())) for i, s, t in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    named = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    named += [None] * (None in sizes)
    weights = {s: pattern[i % len(pattern)] for i, s in enumerate(named)}
    targets = plain_targets(sizes, weights, share, epochs)
    out = []
    for source in named:
        whole = math.floor(targets[source] / sizes[source]) if sizes[source] else 0
        goal, passed = targets[source] - whole * sizes[source], 0
        mine = sorted(
            (hashlib.md5(f"{seed}|{'' if i is None else i}|{n}".encode()).hexdigest()[:15], i, n)
            for i, s, n in sized if s == source
        )
        for _, i, n in mine:
            out.append((i, n, whole + (n > 0 and 2 * passed + n < 2 * goal)))
            passed += n
    return Counter(out), sizes, targets


def mix_rows(n=400):
    drawn = random.Random(5)
    rows = []
    for i in range(n):
        source = drawn.choice(["hot", "hot", "hot", "b", "c", "d", "é", "", None, "tiny"][: 10 if i < 60 else 8])
        words = drawn.choice([0, 1, 3, 20, 200, 900])
        rows.append((i, source, " ".join("w" for _ in range(words)) if words else drawn.choice([None, "", " \n"])))
    return rows + [(7, "hot", "x y z")] * 5


def as_frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, 2, "k") for r in rows], "doc_id long, source string, text string, size long, row int, key string"
    ).repartition(5)


@pytest.mark.parametrize("share, epochs", [(1.5, 2.0), (0.4, 2.0), (5.0, 2.0), (2.0, 2.5)])
def test_mix_is_the_plain_one(spark, share, epochs):
    rows = mix_rows()
    want, sizes, targets = plain_mix(rows, (3.0, 1.0, 2.0), share, epochs, 42)
    mixed = mixing.mix(as_frame(spark, rows), (3.0, 1.0, 2.0), share, epochs, 42).cache()
    got = Counter((r["row"]["doc_id"], r["size"], r["copies"]) for r in mixed.collect())
    assert got == want
    taken, by_source = defaultdict(int), {}
    for r in mixed.collect():
        source = r["row"]["source"]
        taken[source] += r["size"] * r["copies"]
        by_source[source] = (r["source_size"], r["target"])
        assert r["copies"] <= math.ceil(epochs) and r["row"]["key"] == "k"
    for source, (size, target) in by_source.items():
        assert size == sizes[source] and target == pytest.approx(targets[source])
        assert abs(taken[source] - target) <= 450  # half of the largest document
    assert sum(t for _, t in by_source.values()) == pytest.approx(min(share, epochs) * sum(sizes.values()))
    again = mixing.repeated(mixed)
    assert again.columns == ["doc_id", "source", "text", "size", "row", "key"]
    assert again.count() == sum(c * n for (_, _, c), n in want.items())


def test_mix_splits_rows_of_one_id(spark):
    """Nothing but ties: one id with a third of all rows, and a source of one text."""
    rows = [(1, "a", "one two three")] * 900 + [(None, "b", "x")] * 300 + [(5, "c", "y z")] * 300
    mixed = mixing.mix(as_frame(spark, rows), (1.0,), 0.5).collect()
    taken = Counter()
    for r in mixed:
        taken[r["row"]["source"]] += r["size"] * r["copies"]
    target = {r["row"]["source"]: r["target"] for r in mixed}
    for source, size in (("a", 3), ("b", 1), ("c", 2)):
        assert abs(taken[source] - target[source]) <= size / 2 + 1e-9


def test_mix_takes_weights_as_rows(spark):
    rows = [(i, s, "w " * 10) for i, s in enumerate(["a", "a", "b", "b", None, "none"])]
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), (None, 3.0)], "source string, weight double")
    got = {r["row"]["source"]: r["target"] for r in mixing.mix(as_frame(spark, rows), weights, 0.5).collect()}
    assert got == {"a": 10.0, "b": 0.0, None: 20.0, "none": 0.0}


def test_mix_without_rows_or_words(spark):
    assert mixing.mix(as_frame(spark, mix_rows(5)).limit(0), (3.0, 1.0), 1.5).collect() == []
    rows = [(1, "a", None), (2, None, ""), (3, "b", " ")]
    assert {r["copies"] for r in mixing.mix(as_frame(spark, rows), (3.0, 1.0), 1.5).collect()} == {0}


def test_larger_tables_join_under_salts(spark, monkeypatch):
    rows = mix_rows()
    few = mixing.mix(as_frame(spark, rows), (3.0, 1.0, 2.0), 1.5)
    few = Counter((r["row"]["doc_id"], r["size"], r["copies"], r["target"]) for r in few.collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    many = mixing.mix(as_frame(spark, rows), (3.0, 1.0, 2.0), 1.5)
    assert few == Counter((r["row"]["doc_id"], r["size"], r["copies"], r["target"]) for r in many.collect())


# ---- cover trees and codes


@pytest.mark.parametrize("seed", range(6))
def test_tree_gives_what_comparing_gives(seed):
    rng = np.random.default_rng(seed)
    groups = rng.integers(-3000, 3000, (5, 8))
    points = groups[rng.integers(0, 5, 700)] + rng.integers(-(10**seed), 10**seed + 1, (700, 8))
    points = np.concatenate([points, np.repeat(points[:1], 300, axis=0)])
    order, nodes = cover_tree.build(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for node in nodes:  # covering, and separation of children
        gaps = points[order[node["low"] : node["high"]]] - points[node["centre"]]
        assert np.sqrt((gaps**2).sum(axis=1)).max() <= node["radius"] * (1 + 1e-12)
        kids = nodes[node["kids"] : node["kids"] + node["n_kids"]]["centre"]
        apart = np.sqrt(cover_tree.squared(points[kids], points[kids]).astype(float))
        assert (apart[np.triu_indices(len(kids), 1)] > node["radius"] / 2).all()
    centres = np.concatenate([points[:9], points[:2], points[:1] + 1])  # with equal ones
    want = cover_tree.squared(points, centres).argmin(axis=1)
    assert (cover_tree.entries(points, order, nodes, centres) == want).all()
    counts, added = cover_tree.sums(points, order, nodes, centres)
    assert (counts == np.bincount(want, minlength=len(centres))).all()
    for i in range(len(centres)):
        assert (added[i] == points[want == i].sum(axis=0)).all()


def plain_codes(rows, parts, entries, rounds, factor):
    kept = sorted(
        (r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    x = [[math.floor(factor * c) for c in r[1]] for r in kept]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            members = defaultdict(list)
            for v in cut:
                members[near(p, v[p])[1]].append(v[p])
            for i, m in members.items():
                new[p][i] = [sum(c) // len(m) for c in zip(*m)]
        books = new
    out, labels = [], Counter()
    for r, v in zip(kept, cut):
        found = [near(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), error))
        labels[r[2]] += error
    numbers = ",".join(str(c) for b in books for e in b for c in e)
    return Counter((*o[:1], *o[2:], labels[o[1]]) for o in out), hashlib.sha256(numbers.encode()).hexdigest()


def vector_rows(n=300, size=16):
    drawn = random.Random(2)
    rows = [
        (i, [drawn.gauss(i % 4 - 1, 0.3) for _ in range(size)], drawn.choice([0, 1, None]), "x", 1.5) for i in range(n)
    ]
    rows += [rows[3]] * 40 + [(None, rows[5][1], 2, "x", None), (4, [0.0] * size, 1, None, None)]
    rows += [(900, None, 1, "x", 1.0), (901, [NAN] * size, 1, "x", 1.0), (902, [None, *[0.5] * (size - 1)], 1, "x", 1.0)]
    rows += [(-5, [INF] * size, 0, "x", 1.0), (903, [], 1, "x", 1.0)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int, code string, error double"
    ).repartition(4)


@pytest.mark.parametrize("parts, entries", [(8, 16), (4, 256), (2, 3)])
def test_codes_are_the_plain_ones(spark, monkeypatch, parts, entries):
    monkeypatch.setattr(vector_codes, "CHUNK", 50)
    rows = vector_rows()
    want, digest = plain_codes(rows, parts, entries, 6, 4096)
    coded, books = vector_codes.compress(vector_frame(spark, rows), parts, entries)
    assert Counter((r["id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert vector_codes.books_digest(books) == digest


def test_codes_of_few_rows(spark):
    rows = vector_rows(6)[:3]
    want, digest = plain_codes(rows, 8, 16, 6, 4096)
    coded, books = vector_codes.compress(vector_frame(spark, rows))
    assert Counter((r["id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert vector_codes.books_digest(books) == digest
    coded, books = vector_codes.compress(vector_frame(spark, rows).limit(0))
    assert coded.collect() == [] and coded.columns == ["id", "label", "code", "error", "label_error"]
    other = [(1, [0.5] * 16, 1, "x", 1.0), (2, [0.25] * 16, 1, "x", 1.0), (3, [1.0] * 8, 1, "x", 1.0)]
    assert vector_codes.compress(vector_frame(spark, other))[0].count() == 2  # most have 16
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vector_frame(spark, [(1, [0.5] * 15, 1, "x", 1.0)]))


# ---- eigenvectors and whitening


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 9, 40), np.exp(-np.arange(50.0)), np.ones(12), np.array([2.0]),
        np.concatenate([[5, 5, 5 + 1e-9, 4, 4 + 1e-12, 3], np.linspace(1, 2, 30), [1e-3] * 8]),
        1 + 1e-8 * np.arange(40), np.concatenate([[1e6] * 4, np.zeros(9), [1, 1]]),
    ],
)
def test_eigen_to_more_than_double_precision(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = (3 * q - q @ (q.T @ q)) / 2
    a = (q * values.astype(np.longdouble)) @ q.T
    found, x = eigen((a + a.T) / 2)
    size = np.abs(values).max()
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-17 * size
    assert np.abs(x.T @ x - np.eye(n)).max() <= 1e-17
    assert np.abs(a @ x - x * found).max() <= 1e-17 * size
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(single.T @ single - np.eye(n)).max() > 1e-12 or n == 1  # refined, not started there


def test_eigen_of_nothing():
    values, x = eigen(np.zeros((3, 3)))
    assert (values == 0).all() and (x == np.eye(3)).all()


def plain_whitening(rows, components, factor=1024, add=100_000):
    kept = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(factor * c) + add for c in r[1]] for r in kept]
    n, size = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    off = [[n * v - s for v, s in zip(row, sums)] for row in x]
    v = [[sum(a[i] * a[j] for a in off) / n**3 for j in range(size)] for i in range(size)]
    values, vectors = np.linalg.eigh(np.array(v))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = (np.array(off, float) / n) @ vectors / np.sqrt(values)
    return kept, [sum(c * c for c in a) for a in off], white, values / np.trace(v), n


def test_whitening_is_the_plain_one(spark):
    rows = [(r[0], [c + 0.1 * i * r[1][0] for i, c in enumerate(r[1])], *r[2:]) if r[1] and len(r[1]) > 1 and r[1][0]
            and all(c is not None for c in r[1]) else r for r in vector_rows()]
    kept, deviation, white, shares, n = plain_whitening(rows, 3)
    got = whitening.whiten(vector_frame(spark, rows), 3).collect()
    assert Counter(r["id"] for r in got) == Counter({i: 3 * k for i, k in Counter(r[0] for r in kept).items()})
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-11
    assert len({r["identity_error"] for r in got}) == 1
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["id"], r["deviation"]][r["component"]] = r
    for k in range(3):
        sign = {np.sign(white[i, k] * by_id[row[0], deviation[i]][k + 1]["whitened"]) for i, row in enumerate(kept)}
        assert len(sign - {0.0}) == 1
        for i, row in enumerate(kept):
            r = by_id[row[0], deviation[i]][k + 1]
            assert abs(r["whitened"]) == pytest.approx(abs(white[i, k]), rel=1e-9, abs=1e-9)
            assert r["explained"] == pytest.approx(shares[k], rel=1e-10)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vector_frame(spark, vector_rows()).limit(0)).collect() == []
    one = whitening.whiten(vector_frame(spark, [(1, [0.5, 1.0], 1, "x", 1.0)])).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"]) for r in one] == [(1, None, 0, 0), (2, None, 0, 0)]
    flat = [(i, [0.5, float(i), 2.0], 1, "x", 1.0) for i in range(5)]  # variance in one place only
    got = whitening.whiten(vector_frame(spark, flat)).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True, 3: True}
    assert {r["explained"] for r in got if r["component"] == 1} == {1.0}
    large = [(i, [1e30 * (i % 2), -3e8 * i, 1.0 * i], 1, "x", 1.0) for i in range(6)]
    got = whitening.whiten(vector_frame(spark, large)).collect()
    assert len(got) == 18 and got[0]["identity_error"] < 1e-4


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 25, 40):
        x = rng.integers(-(1 << bits), 1 << bits, (5000 if bits < 30 else 60, 6))
        wide = x.astype(object)
        assert (whitening.products(x) == wide.T @ wide).all()
