"""Whitening against an exact covariance in NumPy, vector codes against plain Lloyd rounds in integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import DATA

from tessellex.llm import vector_codes, whitening
from tessellex.llm.registry import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls, non-finite entries, repeated rows and ids, null ids and labels, a hot vector, and columns of any name."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(size=16) * np.arange(1, 17)], int(i) % 3) for i in rng.permutation(300)]
    rows += [(400, rows[0][1], None), (400, rows[0][1], None), (None, rows[1][1], 1), (401, None, 1), (402, [1.0] * 15 + [None], 1), (403, [1.0] * 15 + [math.inf], 1), (404, [1.0] * 15 + [math.nan], 1)]
    rows += [(500 + i, [0.25] * 16, 2) for i in range(150)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    return [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], df.select("*", F.lit(0).alias("n"), F.lit(1).alias("v"), F.lit("x").alias("vc_code"))


def covariance(x):
    """Exact integers n*x - S, and the covariance as doubles of exact sums."""
    n, s = len(x), x.sum(axis=0)
    y = x.astype(object) * n - s.astype(object)
    c = y.T @ y
    return y, np.array([[float(v) / float(n) ** 3 for v in r] for r in c])


def held(got, rows, components):
    x = np.floor(64 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64) + 1_000_000
    y, c = covariance(x)
    values, axes = np.linalg.eigh(c)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    white = (y.astype(np.float64) / len(x)) @ axes[:, :k] / np.sqrt(values[:k])
    deviation = [int(sum(v * v for v in r)) for r in y]
    assert len(got) == len(rows) * k and {r.n for r in got} == {len(rows)}
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter((i, j + 1, d) for (i, _, _), d in zip(rows, deviation, strict=True) for j in range(k))
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(c), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    mine = {}
    for r in got:
        mine.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    for j in range(k):
        want = {}
        for (i, _, _), w in zip(rows, white[:, j], strict=True):
            want.setdefault(i, []).append(w)
        a = np.array([v for i in sorted(want, key=str) for v in sorted(want[i])])
        for sign in (1, -1):
            b = np.array([v for i in sorted(want, key=str) for v in sorted(sign * v for v in mine[j + 1][i])])
            if np.abs(a - b).max() < 1e-6:
                break
        else:
            raise AssertionError(f"component {j + 1}")


def test_whitening(spark, vectors):
    rows, df = vectors
    held(whitening.whiten(df).collect(), rows, 32)
    assert whitening.whiten(df, components=4).where("component > 4").count() == 0


def test_whitening_of_all_embeddings(spark):
    sf = str(DATA / "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    held(QUERIES["op12_whitening"](spark, sf).collect(), rows, 32)


def test_factors_merge_in_several_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 0) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS).repartition(whitening.FAN * 2 + 3)
    held(whitening.whiten(df, components=3).collect(), [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows], 3)


def test_whitening_without_variance(spark):
    """No vectors, one, equal ones and dimensions that don't vary; lengths that differ are an error."""
    one = [(1, [1.0, 2.0, 3.0], 0)]
    assert whitening.whiten(spark.createDataFrame(one, VECTORS).where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame(one, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(one * 5, VECTORS)).count() == 0
    flat = [(i, [float(i), 7.0, float(2 * i)], 0) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and got[0].explained == pytest.approx(1)
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(spark.createDataFrame([*one, (2, [1.0], 0)], VECTORS).coalesce(1)).collect()


def test_deviations_are_exact():
    mean = whitening.Mean.of(3, [3_000_001, 2_999_999])
    x = np.array([[1_000_000, 1_000_001], [999_999, 5]])
    assert mean.deviations(x).tolist() == [[3 * 1_000_000 - 3_000_001, 3 * 1_000_001 - 2_999_999], [3 * 999_999 - 3_000_001, 15 - 2_999_999]]
    far = whitening.Mean.of(1 << 40, [0, 0])
    assert [int(v) for v in far.deviations(np.array([[1 << 30, 1]]))[0]] == [1 << 70, 1 << 40]
    assert whitening.squares(np.array([[3, 4]])) == [25]
    with pytest.raises(OverflowError):
        whitening.squares(np.array([[1 << 32, 0]]))


def lloyd(rows, rounds=6, parts=8, k=16):
    """Each round scans everything, in Python integers."""
    x = [[math.floor(4096 * c) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:k]
    books = [[x[i][p * w : (p + 1) * w] for i in order] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(r[p * w : (p + 1) * w], books[p][e]), e)) for p in range(parts)] for r in x]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[p * w : (p + 1) * w] for r, c in zip(x, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(far(r[p * w : (p + 1) * w], books[p][c[p]]) for p in range(parts)) for r, c in zip(x, codes, strict=True)]
    by_label = Counter()
    for (_, _, y), e in zip(rows, errors, strict=True):
        by_label[y] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(map(repr, [(i, "".join(f"{e:02x}" for e in c), e, by_label[y], sha) for (i, _, y), c, e in zip(rows, codes, errors, strict=True)]))


def test_vector_codes_of_all_embeddings(spark):
    sf = str(DATA / "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op13_vector_codes"](spark, sf)
    assert sorted(map(repr, map(tuple, got.collect()))) == lloyd(rows)


@pytest.mark.parametrize("block", [4096, 20])
def test_vector_codes_edges(spark, tmp_path, monkeypatch, vectors, block):
    """Nulls, ties, repeated rows, null ids and labels, a hot vector, other columns; also in small blocks."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows, df = vectors
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_vector_codes"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == lloyd(rows)


def test_few_vectors(spark, tmp_path):
    rows = [(i, [float(i)] * 8, None) for i in range(3)] * 2
    for n in (6, 1, 0):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows[:n], VECTORS).write.parquet(str(folder / "embeddings.parquet"))
        got = QUERIES["op13_vector_codes"](spark, str(folder))
        assert sorted(map(repr, map(tuple, got.collect()))) == (lloyd(rows[:n]) if n else [])
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 0)], VECTORS))


def test_heaps_spare_most_scans(spark):
    """Of well-separated parts, rounds after the first two scan few; none that a full scan would move is missed (the tests above)."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(16, 16)) * 50
    rows = [(i, [float(v) for v in centres[i % 16] + rng.normal(size=16)], 0) for i in range(3000)]
    _, _, scans = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
    assert scans[0] == 3000 * 8 and sum(scans[2:]) < 0.05 * 5 * 3000 * 8


def test_blocks_of_one_vector_in_many_places():
    """Ties go to the lower entry, unused entries stay and don't drift."""
    books = vector_codes.Books(np.zeros((8, 2, 1), np.int64), np.zeros((8, 2), np.int64))
    b = vector_codes.Block(np.ones((5, 8), np.int64), books)
    assert b.begin(books) == 40 and not b.codes.any() and b.sums[0].tolist() == [[5, 5], [0, 0]]
    on = books.moved_to(np.array([[[1], [0]]] * 8))
    assert b.advance(on) == 40 and not b.codes.any() and b.errors(on).tolist() == [0] * 5
    assert b.advance(on.moved_to(on.entries)) == 0
