import random

import numpy as np
import pytest

from fieldloom.llm import graded_quality as G


def test_features_match_brute_force():
    texts = ["a b a", "", "Ab1 c!", "x" * 5000]
    d, b, v = G.text_features(texts)
    assert len(d[d == 1]) == 0 and len(d[d == 3]) >= 1
    for i in (0, 2, 3):
        assert abs((v[d == i] ** 2).sum() - 1) < 1e-9
    two = v[d == 0]
    assert len(two) == 2 and abs(max(two) / min(two) - np.log(3) / np.log(2)) < 1e-9


def corpus(spark, n=3000):
    rng = random.Random(4)
    rows, grades = [], []
    for i in range(n):
        g = rng.choice([0, 1, 2, 2])
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(40)]
        marks = {0: ["%%%", "HEY!!"], 1: ["meh"], 2: ["fine"]}[g]
        words += [rng.choice(marks) for _ in range(6)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), 9))
        grades.append((i, g))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int"), spark.createDataFrame(grades, "doc_id long, grade int"), [g for _, g in grades]


def test_held_out_grades(spark):
    docs, graded, truth = corpus(spark)
    model = G.train(docs, graded.filter("doc_id < 2000"), fit_rows=1500)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in G.score(docs, model).collect()}
    held = range(2000, 3000)
    assert np.mean([got[i].kept == (truth[i] > 0) for i in held]) > 0.97
    means = [np.mean([got[i].expected_grade for i in held if truth[i] == g]) for g in (0, 1, 2)]
    assert means[0] < 0.5 < means[1] < 1.6 < means[2]


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, "word " * 30000), (3, "😀!" * 30000)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = G.train(df, spark.createDataFrame([(1, 1), (1, None), (7, 2)], "doc_id long, grade int"))
    got = G.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_grade <= 2 for r in got)


def loss(w, cuts, x, grade, ridge=2e-4):
    """Negative log-likelihood a row and the ridge, straight from the definition."""
    below = lambda j, z: 0.0 if j < 0 else 1.0 if j >= len(cuts) else 1 / (1 + np.exp(-(cuts[j] - z)))
    total = -sum(np.log(max(below(g, z) - below(g - 1, z), 1e-12)) for z, g in zip(x @ w, grade, strict=True))
    return total / len(grade) + ridge / 2 * (w @ w)


def searched(x, grade, grades):
    """The least loss by a pattern search over weights and thresholds: no gradients, another start."""
    p = np.concatenate([np.zeros(x.shape[1]), np.linspace(-1, 1, grades - 1)])
    value = lambda p: loss(p[: x.shape[1]], p[x.shape[1] :], x, grade) if (np.diff(p[x.shape[1] :]) > 0).all() else np.inf
    best, step = value(p), 1.0
    while step > 1e-3:
        better = False
        for i in range(len(p)):
            for move in (step, -step):
                q = p.copy()
                q[i] += move
                if (v := value(q)) < best:
                    p, best, better = q, v, True
        step = step if better else step / 2
    return best, p


@pytest.mark.parametrize(("grades", "seed"), [(2, 1), (3, 2), (4, 3)])
def test_fit_reaches_the_least_loss(grades, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 3))
    z = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=150)
    grade = np.searchsorted(np.quantile(z, np.arange(1, grades) / grades), z)
    doc, at = np.repeat(np.arange(150), 3), np.tile([5, 77, 4000], 150)
    model = G.fit(doc, at, x.ravel(), grade, grades, steps=2000)
    least, p = searched(x, grade, grades)
    own = loss(model.weights[[5, 77, 4000]], model.thresholds, x, grade)
    assert abs(own - least) < 1e-4 and np.count_nonzero(model.weights) == 3
    assert np.abs(model.weights[[5, 77, 4000]] - p[:3]).max() < 0.05 and np.abs(model.thresholds - p[3:]).max() < 0.05
    tails = model.tails(np.array([0.3]))[0]
    assert np.allclose(tails, [1 - 1 / (1 + np.exp(-(c - 0.3))) for c in model.thresholds]) and (np.diff(tails) < 0).all()
