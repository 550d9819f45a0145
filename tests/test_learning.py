"""TF-IDF of training sides and the classifiers over it, against plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import DATA

from tessellex.operators import bayes, learning, linear, logistic
from tessellex.plans import NormalizationStudy
from tessellex.queries import learning as ql

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def corpus(spark):
    """(tf, items) as tables and as Python: term counts by item, and label and fold by item."""
    tf, items = ql.counts(spark, SF), ql.folds(spark, SF)
    terms = defaultdict(dict)
    for r in tf.collect():
        terms[r["item"]][r["term"]] = r["tf"]
    return tf, items, terms, {r["item"]: (r["label"], r["fold"]) for r in items.collect()}


def weights(terms, of, fold):
    """The rows of all items by the training side of a fold, and that side's document frequencies."""
    train = [i for i in of if of[i][1] != fold]
    df = Counter(t for i in train for t in terms[i])
    out = {}
    for i in of:
        w = {t: c * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t, c in terms[i].items() if t in df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out[i] = {t: v / norm for t, v in w.items()}
    return out, df


def test_rows(corpus):
    tf, items, terms, of = corpus
    rows, index = learning.tfidf_rows(tf, items, ql.K)
    ids = {r["term"]: r["id"] for r in index.collect()}
    assert sorted(ids.values()) == list(range(len({t for i in of for t in terms[i]})))
    want = [weights(terms, of, f)[0] for f in range(ql.K)]
    for r in rows.collect():
        for f in range(ql.K):
            got = {e["term"]: e["tf"] * e["idf"][f] / r["norms"][f] for e in r["entries"] if e["idf"][f] is not None}
            assert got == pytest.approx(want[f][r["item"]])
            assert all(e["id"] == ids[e["term"]] for e in r["entries"])
    for r in learning.fold_features(rows, 2, len(ids)).collect():
        assert dict(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)) == pytest.approx({ids[t]: w for t, w in want[2][r["item"]].items()})


def test_naive_bayes(corpus):
    tf, items, terms, of = corpus
    got = {r["item"]: r["pred"] for r in learning.naive_bayes(tf, items, ql.K).collect()}
    for f in range(ql.K):
        w, df = weights(terms, of, f)
        mass, prior = defaultdict(Counter), Counter()
        for i, (y, g) in of.items():
            if g != f:
                prior[y] += 1
                mass[y].update(w[i])
        for i in (i for i in of if of[i][1] == f):
            score = lambda y: math.log(prior[y] / sum(prior.values())) + sum(v * math.log((mass[y][t] + 1) / (sum(mass[y].values()) + len(df))) for t, v in w[i].items())  # noqa: B023, E731
            assert got[i] == max(sorted(prior), key=lambda y: round(score(y), 9))

def test_naive_bayes_in_blocks(corpus, monkeypatch):
    """The same predictions in one block and in many; a block's terms travel once, so there are fewer rows than items have terms."""
    tf, items, _, _ = corpus
    want = {r["item"]: r["pred"] for r in learning.naive_bayes(tf, items, ql.K).collect()}
    monkeypatch.setattr(bayes, "ENTRIES", max(1, tf.count() // 40))
    assert {r["item"]: r["pred"] for r in learning.naive_bayes(tf, items, ql.K).collect()} == want
    t = tf.join(items.select("item", "fold", F.lit(0).alias("y")), "item")
    held = bayes.held_counts(bayes.packed(t, 2), ql.K)
    assert held.count() < t.count() and held.agg(F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda x, v: x + v))).first()[0] == t.count()


def test_logistic_regression(corpus):
    """The same objective by Newton's method over the kernel of the rows; labels agree wherever the margin isn't next to nothing."""
    tf, items, terms, of = corpus
    got = {r["item"]: r["pred"] for r in learning.text_predict(tf, items, ql.K, "lr").collect()}
    assert set(got) == set(of)
    checked = 0
    for f in range(ql.K):
        w, _ = weights(terms, of, f)
        train, test = [i for i in of if of[i][1] != f], [i for i in of if of[i][1] == f]
        dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
        gram = np.array([[dot(w[i], w[j]) for j in train] for i in train])
        y = np.array([float(of[i][0]) for i in train])
        a, b = np.zeros(len(train)), 0.0
        for _ in range(50):  # a = y - p at the optimum, since w is the sum of a times the rows
            p = 1 / (1 + np.exp(-(gram @ a + b)))
            s = p * (1 - p)
            left = np.block([[np.eye(len(y)) + s[:, None] * gram, s[:, None]], [np.ones((1, len(y))), np.zeros((1, 1))]])
            step = np.linalg.solve(left, np.concatenate((y - p - a, [-a.sum()])))
            a, b = a + step[:-1], b + step[-1]
        assert np.abs(y - 1 / (1 + np.exp(-(gram @ a + b))) - a).max() < 1e-9
        for i in test:
            margin = sum(c * dot(w[i], w[j]) for c, j in zip(a, train, strict=True)) + b
            if abs(margin) > 0.005:
                checked += 1
                assert got[i] == int(margin > 0)
    assert checked > 0.9 * len(of)


def test_logistic_regression_of_three_labels(spark, monkeypatch):
    """The multinomial model in many blocks and pieces, with items without terms, against L-BFGS over the whole matrix."""
    monkeypatch.setattr(bayes, "ENTRIES", 40)
    monkeypatch.setattr(logistic, "PIECE", 512)
    rng = np.random.default_rng(5)
    of = {i: (f"class {i % 3}", i // 3 % 2) for i in range(90)}
    terms = {i: Counter(f"w{w}" for w in rng.integers(0, 40, 12) + 6 * (i % 3)) if i % 15 else Counter() for i in of}
    tf = spark.createDataFrame([(i, t, c) for i in of for t, c in terms[i].items()], "item long, term string, tf long")
    items = spark.createDataFrame([(i, y, f) for i, (y, f) in of.items()], "item long, label string, fold int")
    got = {r["item"]: (r["label"], r["pred"]) for r in logistic.logistic(tf, items, 2).collect()}
    assert set(got) == set(of) and all(got[i][0] == of[i][0] for i in of)
    names, checked = sorted({y for y, _ in of.values()}), 0
    for f in range(2):
        train = [i for i in of if of[i][1] != f]
        df = Counter(t for i in train for t in terms[i])
        ids = {t: j for j, t in enumerate(sorted(df))}
        x = np.zeros((len(of), len(ids) + 1))
        for i in of:
            for t, c in terms[i].items():
                if t in ids:
                    x[i, ids[t]] = c * (math.log((1 + len(train)) / (1 + df[t])) + 1)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
        x[:, -1] = 1
        y, side = np.array([names.index(of[i][0]) for i in of]), np.isin(np.arange(len(of)), train)
        weighed = np.tile(np.append(np.ones(len(ids)), 0.0), (3, 1))
        run = linear.lbfgs(3 * x.shape[1], 1e-9, 500)
        w = next(run)
        try:
            while True:
                a = w.reshape(3, -1)
                value, slopes = logistic.loss(x[side] @ a.T, y[side])
                w = run.send((value.sum() + 0.5 * float((weighed * a * a).sum()), (slopes.T @ x[side] + weighed * a).ravel()))
        except StopIteration as end:
            w = end.value.reshape(3, -1)
        for i in of:
            margins = np.sort(x[i] @ w.T)
            if of[i][1] == f and margins[-1] - margins[-2] > 1e-3:
                checked += 1
                assert got[i][1] == names[int((x[i] @ w.T).argmax())]
    assert checked > 80


def test_logistic_regression_sends_the_driver_no_model(spark, monkeypatch):
    """24,000 terms: nothing is broadcast, and what the driver collects at once is a few numbers a block and fold."""
    sent = []

    def collect(df, _collect=type(spark.range(1)).collect):
        rows = _collect(df)
        sent.append(sum(len(c) if isinstance(c, (list, bytes, bytearray, str)) else 1 for r in rows for c in r))
        return rows

    def broadcast(*_):
        raise AssertionError("a broadcast")

    tf = spark.range(60).selectExpr("id AS item", "explode(sequence(0, 400)) AS w").selectExpr("item", "if(w = 0, concat('y', item % 2), concat(item, ' ', w)) AS term", "1L AS tf")
    items = spark.range(60).selectExpr("id AS item", "id % 2 AS label", "int(id div 2 % 2) AS fold")
    monkeypatch.setattr(type(spark.range(1)), "collect", collect)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert len(learning.text_predict(tf, items, 2, "lr").collect()) == 60
    assert len(sent) > 3 and max(sent) < 2 * 8 * 100


def test_classifiers_find_a_word(spark):
    """Each classifier tells texts apart by one word, on TF-IDF and through a vectorizer; items without terms are predicted, too."""
    rows = [(i, w := ("good " if i % 2 else "bad ") + f"w{i % 7} w{i}", w.upper(), i % 2) for i in range(40)]
    study = NormalizationStudy(spark.createDataFrame([*rows, (40, "", "", 0), (41, "", "", 1)], "doc_id long, raw string, norm string, label int"))
    for clf in ("mnb", "lr", "svc", "rf"):
        r = study.downstream(k=2, classifier=clf).head()
        assert r.f1_raw >= 0.8 and r.f1_norm >= 0.8
    ends = lambda d, side: d.select("item", F.array(F.lower("text").startswith("good").cast("double")).alias("features"))
    r = study.downstream(k=2, classifier="lr", vectorizer=ends).head()
    assert r.f1_raw >= 0.9 and r.delta == 0


def test_naive_bayes_leaves_only_its_predictions(corpus):
    """Scratch tables of the terms go when a fit has been read, so queries of four fits hold those of one at a time."""
    from tessellex.sources import scratch

    tf, items = corpus[:2]
    made = scratch._tables(items.sparkSession)
    before = len(made)
    pred = learning.naive_bayes(tf, items, ql.K)
    assert len(made) == before + 1 and pred.count() == items.count()
