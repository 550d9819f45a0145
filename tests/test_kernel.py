"""The support vector machine over random features against a dual solver over the whole kernel matrix."""

from itertools import combinations

import numpy as np
import pytest
from tests_support import DATA

from tessellex.operators import kernel, learning
from tessellex.queries import QUERIES


def dual(gram, y, c=1.0, steps=20_000):
    """alpha * y and the intercept by sequential minimal optimisation of the most violating pair."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        f = -y * g
        i, j = np.flatnonzero(up)[f[up].argmax()], np.flatnonzero(low)[f[low].argmin()]
        if f[i] - f[j] < 1e-4:
            break
        t = (f[i] - f[j]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        t = min(t, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += y * t * (gram[:, i] - gram[:, j])
    return a * y, (f[i] + f[j]) / 2


def machine(x, y, new):
    width = 1 / (x.shape[1] * x.var())
    k = lambda a, b: np.exp(-width * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    labels = sorted(set(y.tolist()))
    votes = np.zeros((len(new), len(labels)), int)
    for p, q in combinations(range(len(labels)), 2):
        own = (y == labels[p]) | (y == labels[q])
        w, b = dual(k(x[own], x[own]), np.where(y[own] == labels[p], 1.0, -1.0))
        first = k(new, x[own]) @ w + b > 0
        votes[:, p] += first
        votes[:, q] += ~first
    return np.array(labels)[votes.argmax(axis=1)]


def compared(spark, x, y, k):
    """(share of equal predictions, accuracy, the dual solver's accuracy) over k folds."""
    folds = np.arange(len(y)) % k
    df = spark.createDataFrame([(i, int(folds[i]), int(y[i]), x[i].tolist()) for i in range(len(y))], "item long, fold int, label int, features array<double>")
    got = {r["item"]: r["pred"] for r in learning.fit_predict(df, k, "svc").collect()}
    want = np.zeros(len(y), int)
    for f in range(k):
        want[folds == f] = machine(x[folds != f], y[folds != f], x[folds == f])
    mine = np.array([got[i] for i in range(len(y))])
    return (mine == want).mean(), (mine == y).mean(), (want == y).mean()


def test_rings_and_blobs(spark):
    """A ring around a blob, which no linear classifier tells apart, and four classes."""
    rng = np.random.default_rng(8)
    angle, far = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 3.0, 0.8) + rng.normal(0, 0.25, 300)
    ring = np.stack((far * np.cos(angle), far * np.sin(angle)), axis=1)
    same, mine, other = compared(spark, ring, np.arange(300) % 2, 3)
    assert same >= 0.98 and mine >= 0.98 and other >= 0.98
    y = rng.integers(0, 4, 240)
    blobs = rng.normal(0, 1.6, (240, 5)) + np.eye(4, 5)[y] * 4
    same, mine, other = compared(spark, blobs, y, 2)
    assert same >= 0.93 and abs(mine - other) <= 0.03


def test_vectors(spark):
    """Accuracy over the embeddings within 0.04 of the dual solver's, whose labels are nearly random; each vector has one prediction."""
    sf = str(DATA / "sf0.001")
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect())
    x, y = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    got = {r["item"]: r for r in QUERIES["q_svc"](spark, sf).collect()}
    assert set(got) == {r["vec_id"] for r in rows} and all(got[r["vec_id"]]["label"] == r["label"] for r in rows)
    folds = np.array([got[r["vec_id"]]["fold"] for r in rows])
    want = np.zeros(len(y), int)
    for f in range(5):
        want[folds == f] = machine(x[folds != f], y[folds != f], x[folds == f])
    mine = np.array([got[r["vec_id"]]["pred"] for r in rows])
    assert abs((mine == y).mean() - (want == y).mean()) <= 0.04


def test_sparse_rows_are_projected_as_dense_ones():
    """The projection of an input dimension is the same wherever it is made; products of cosines are kernel values."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 9)) / 3
    p = x @ np.stack([kernel.direction(i, 8192, 42) for i in range(9)])
    z = np.sqrt(2 / 8192) * np.cos(p * np.sqrt(2 * 0.7) + kernel.offsets(8192, 42))
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.05
    values, slopes = kernel.hinge(np.array([0.0, 1.0, 2.0]))
    assert values.tolist() == pytest.approx([1.0, kernel.SMOOTH / 4, 0.0]) and slopes.tolist() == [-1.0, -0.5, 0.0]


def test_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(i, i % 2, 7, [float(i)]) for i in range(4)], "item long, fold int, label int, features array<double>")
    assert {r["pred"] for r in learning.fit_predict(df, 2, "svc").collect()} == {7}
    assert learning.fit_predict(df.where("false"), 2, "svc").count() == 0
