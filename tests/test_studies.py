"""Queries that SQL can't express, against plain Python over the same tables."""

import difflib
import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tests_support import DATA, interval

from tessellex.functions import probability, snowball, stemmers, text
from tessellex.operators import inference, learning, ranking, statistics
from tessellex.queries import QUERIES
from tessellex.queries import learning as ql
from tessellex.queries import retrieval as qr

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def digest(tokens):
    return hashlib.md5(" ".join(tokens).encode()).hexdigest()


def stems(tokens, lang):
    f = stemmers.stemmer_of(lang)
    return [f(t) for t in tokens] if f else tokens


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_stem_queries(spark, rows):
    words = {r.doc_id: regex.findall(r"[\p{L}\p{N}_]+", (r.text or "").lower()) for r in rows}
    got = {r.doc_id: (r.n, r.digest) for r in QUERIES["q_porter"](spark, SF).collect()}
    assert got == {r.doc_id: (len(words[r.doc_id]), digest(map(stemmers.porter, words[r.doc_id]))) for r in rows if r.lang == "en"}
    got = {tuple(r) for r in QUERIES["q_stem"](spark, SF).select("lang", "token", "stem").collect()}
    assert got == {(r.lang, t, stemmers.BY_LANGUAGE[r.lang](t)) for r in rows for t in words[r.doc_id]} and {r.lang for r in rows} == {x[0] for x in got}
    full = {r.doc_id: stems(text.orthographic(r.text).split(), r.lang) for r in rows}
    assert {r.doc_id: (r.n, r.digest) for r in QUERIES["q_full_pipeline"](spark, SF).collect()} == {i: (len(t), digest(t)) for i, t in full.items()}
    assert snowball.french("continuellement") == "continuel"


def kinds(rows):
    out = defaultdict(lambda: defaultdict(Counter))
    for r in rows:
        ortho = text.orthographic(r.text).split()
        for name, t in (("raw", (r.text or "").split()), ("ortho", ortho), ("full", stems(ortho, r.lang))):
            out[r.lang][name].update(t)
    return out


def test_cr_stems(spark, rows):
    want = kinds(rows)
    for r in QUERIES["q_cr_stems"](spark, SF).collect():
        raw, ortho, full = (len(want[r.lang][c]) for c in ("raw", "ortho", "full"))
        assert (r.v_raw, r.v_ortho, r.v_full) == (raw, ortho, full)
        assert (r.cr_total, r.cr_ortho, r.cr_morph) == (round(raw / full, 6), round(raw / ortho, 6), round(ortho / full, 6))
        assert r.morph_share == pytest.approx(math.log(ortho / full) / math.log(raw / full), abs=1e-6)


def distances(docs, padded):
    """By language the distance of each source word to its first target; docs: doc_id, lang, raw, norm in order of doc_id."""
    first = defaultdict(dict)
    ops = Counter()
    for _, lang, a, b in docs:
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=padded).get_opcodes():
            for k in range(i1, i2):
                j = j1 + k - i1
                if tag == "delete" or j >= j2:
                    if tag != "delete" and not padded:
                        continue
                    target = ""
                else:
                    target = b[j]
                ops[tag] += 1
                first[lang].setdefault(a[k], target)
    return {la: {s: levenshtein(s, t) / len(s) for s, t in x.items()} for la, x in first.items()}, ops


def test_alignment_queries(spark, rows):
    docs = [(r.doc_id, r.lang, (r.text or "").split(), text.orthographic(r.text).split()) for r in rows]
    for name, padded in (("q_anld", True), ("q_anld_trunc", False)):
        want, ops = distances(docs, padded)
        got = {r.lang: (r.anld, r.n_types) for r in QUERIES[name](spark, SF).collect()}
        assert {la: n for la, (_, n) in got.items()} == {la: len(x) for la, x in want.items()}
        assert all(got[la][0] == pytest.approx(np.mean(list(x.values())), abs=1e-6) for la, x in want.items())
        if padded:
            assert {r.op: r.n for r in QUERIES["q_align_ops"](spark, SF).collect()} == ops
        else:
            ci = {r.lang: r for r in QUERIES["q_anld_ci"](spark, SF).collect()}
            for la, x in want.items():
                assert ci[la].anld == pytest.approx(np.mean(list(x.values())), abs=1e-6) and ci[la].n_types == len(x)
            la = min(want, key=lambda la: len(want[la]))
            assert (ci[la].lo, ci[la].hi) == pytest.approx(interval(list(want[la]), list(want[la].values())), abs=1.1e-6)


def test_tier_b(spark, rows):
    counts = kinds(rows)
    docs = [(r.doc_id, r.lang, o := text.orthographic(r.text).split(), stems(o, r.lang)) for r in rows]
    want, _ = distances(docs, False)
    lang = {r.doc_id: r.lang for r in rows}
    cosine = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        e = np.array(r.embedding, float)
        if r.vec_id in lang:
            cosine[lang[r.vec_id]].append(e @ np.sign(e) / np.linalg.norm(e) / np.linalg.norm(np.sign(e)))
    least = min(want, key=lambda la: len(want[la]))
    for r in QUERIES["q_tier_b"](spark, SF).collect():
        p, q = counts[r.lang]["ortho"], counts[r.lang]["full"]
        types = set(p) | set(q)
        tp, tq = (sum(x.values()) + 1e-12 * len(types) for x in (p, q))
        kl = sum((p[t] + 1e-12) / tp * math.log(((p[t] + 1e-12) / tp) / ((q[t] + 1e-12) / tq)) for t in types)
        vrg = 1 - len(q) / len(p)
        assert r.irs == pytest.approx(np.mean(cosine[r.lang]), abs=1e-6)
        if r.lang == least:
            assert (r.lo, r.hi) == pytest.approx(interval(list(want[least]), list(want[least].values())), abs=1.1e-6)
        assert r.kl == pytest.approx(kl, abs=1e-5) and r.vrg == pytest.approx(vrg, abs=1e-5)
        assert r.aes == pytest.approx(2 * r.irs * vrg / (r.irs + vrg), abs=1e-5)
        assert r.anld == pytest.approx(np.mean(list(want[r.lang].values())), abs=1e-6) and r.lo <= r.anld <= r.hi and r.n_types == len(want[r.lang])


def test_wilcoxon_enumerates_signs(spark):
    d = [r.norm - r.raw for r in ql.both_sides(spark, SF).collect()]
    (got,) = QUERIES["q_wilcoxon"](spark, SF).collect()
    d = [x for x in d if x]
    ranks = probability.midranks([abs(x) for x in d])
    w = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    assert got.w == w and got.p == pytest.approx(min(1.0, 2 * sum(s <= w + 1e-9 for s in sums) / len(sums)))


def test_mcnemar_p(spark):
    o = QUERIES["q_oof"](spark, SF).collect()
    b = sum(r.label == r.pred_raw != r.pred_norm for r in o)
    c = sum(r.label == r.pred_norm != r.pred_raw for r in o)
    (got,) = QUERIES["q_mcnemar_p"](spark, SF).collect()
    want = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c < 25 else math.erfc((abs(b - c) - 1) / math.sqrt(b + c) / math.sqrt(2))
    assert got.exact == (b + c < 25) and got.p == pytest.approx(want)


def test_ir_comparison(spark):
    a, b = ({r.qid: r["rank"] for r in qr.ranks(spark, SF, c).collect()} for c in ("tok", "cut"))
    rr = lambda x: 1 / x if x <= 10 else 0.0
    d = np.array([rr(b[q]) - rr(a[q]) for q in sorted(a)])
    (got,) = QUERIES["q_ir_compare_ci"](spark, SF).collect()
    assert (got.delta, got.lo, got.hi) == pytest.approx((d.mean(), *interval(sorted(a), d)), abs=1e-8)
    only = [sum(a[q] == 1 != b[q] for q in a), sum(b[q] == 1 != a[q] for q in a)]
    assert [got.a_only, got.b_only] == only and got.p == pytest.approx(probability.mcnemar(*only)[1], abs=1e-8)


def test_paired_ci(spark, rows):
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(len(regex.findall(r"[\p{L}\p{N}_]+", r.text or "")) - len((r.text or "").split()))
    for r in QUERIES["q_paired_ci"](spark, SF).collect():
        d = np.array(by[r.lang], float)
        half = probability.t_quantile(len(d) - 1) * d.std(ddof=1) / math.sqrt(len(d))
        assert (r.n, r.delta, r.lo, r.hi) == (len(d), pytest.approx(d.mean(), abs=1e-6), pytest.approx(d.mean() - half, abs=1e-5), pytest.approx(d.mean() + half, abs=1e-5))


def test_spearman_p(spark):
    (r,) = QUERIES["q_spearman_p"](spark, SF).collect()
    (s,) = QUERIES["q_spearman"](spark, SF).collect()
    assert (r.n, r.rho) == (s.n, s.rho) and r.p == pytest.approx(probability.spearman_p(r.rho, r.n), abs=1e-5)


def test_classifiers_over_features(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, i % 2, [float(x) for x in rng.normal(3 * (i % 2), 0.3, 4)]) for i in range(120)]
    d = spark.createDataFrame(data, "item long, fold int, label int, features array<double>")
    for clf in ("lr", "rf"):
        got = learning.fit_predict(d, 3, clf).collect()
        assert len(got) == 120 and all(r.pred == r.label for r in got)
    r = {x.clf: x for x in QUERIES["q_dsp_features"](spark, SF).collect()}
    assert set(r) == {"lr", "rf"} and all(x.n_folds == 3 and 0 <= x.f1_norm <= 1 and x.delta == pytest.approx(x.f1_norm - x.f1_raw, abs=2e-6) and x.p in (0.25, 0.5, 0.75, 1.0) for x in r.values())


def newton(x, y):
    """Weights and intercept of the logistic regression whose loss is the sum over rows plus half the squared norm."""
    a = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a @ w)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return w[:-1], w[-1]


def f1(pairs):
    """Macro-F1 of (label, prediction) pairs."""
    labels = {v for p in pairs for v in p}
    return np.mean([2 * sum(a == b == y for a, b in pairs) / (sum(a == y for a, _ in pairs) + sum(b == y for _, b in pairs)) for y in labels])


def test_mpd(spark):
    """One half's regression against Newton's method; by label the F1s and discordant counts of its predictions."""
    both = {r.side: r.f1 for r in QUERIES["q_mpd"](spark, SF).collect()}
    assert set(both) == {"raw", "sign"} and all(0 <= v <= 1 for v in both.values())
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    train, held = ([r for r in rows if r.vec_id % 2 == h] for h in (0, 1))
    w, b = newton(np.array([r.embedding for r in train], float), np.array([r.label % 2 for r in train], float))
    sides = [np.array([r.embedding for r in held], float) @ w + b, np.sign(np.array([r.embedding for r in held], float)) @ w + b]
    near = max(np.mean(np.abs(m) < 1e-3) for m in sides)
    by = defaultdict(list)
    for r, x, y in zip(held, *sides, strict=True):
        by[r.label].append((r.label % 2, int(x > 0), int(y > 0)))
    got = {r.group: r for r in QUERIES["q_mpd_change"](spark, SF).collect()}
    assert set(got) == set(by) and near < 0.02
    for g, own in by.items():
        r = got[g]
        assert r.f1_raw == pytest.approx(f1([(y, a) for y, a, _ in own]), abs=0.03) and r.f1_norm == pytest.approx(f1([(y, c) for y, _, c in own]), abs=0.03)
        assert abs(r.a_only - sum(y == a != c for y, a, c in own)) <= 1 and abs(r.b_only - sum(y == c != a for y, a, c in own)) <= 1
        assert r.mpd == pytest.approx(r.f1_norm - r.f1_raw, abs=2e-6) and r.p == pytest.approx(probability.mcnemar(r.a_only, r.b_only)[1], abs=1e-8)


def test_downstream_change_over_features(spark):
    """Logistic regression of each fold against Newton's method, and the query's figures from its F1s."""
    rows = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    items = learning.stratified_folds(spark.createDataFrame([(i, r.label % 2) for i, r in rows.items()], "item long, label int"), "item", "label", k=3).collect()
    fold = {r["item"]: r["fold"] for r in items}
    figures = {}
    for name, turn in (("raw", lambda v: v), ("norm", np.sign)):
        x = {i: turn(np.array(r.embedding, float)) for i, r in rows.items()}
        each = []
        for f in range(3):
            w, b = newton(np.array([x[i] for i in x if fold[i] != f]), np.array([rows[i].label % 2 for i in x if fold[i] != f], float))
            each.append(f1([(rows[i].label % 2, int(x[i] @ w + b > 0)) for i in x if fold[i] == f]))
        figures[name] = np.mean(each)
    r = next(x for x in QUERIES["q_dsp_features"](spark, SF).collect() if x.clf == "lr")
    assert r.f1_raw == pytest.approx(figures["raw"], abs=0.02) and r.f1_norm == pytest.approx(figures["norm"], abs=0.02)


def test_ranks_of_large_groups(spark):
    rng = np.random.default_rng(2)
    values = [(int(g), float(v)) for g, v in zip(rng.integers(0, 2, 3000), rng.integers(0, 40, 3000) ** 2, strict=True)] + [(0, 0.0)] * 1500
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(values)], "i int, g int, v double")
    got = {r.i: r.r for r in ranking.midranks(d, ["g"], "v", "r").collect()}
    for g in (0, 1):
        own = [i for i, x in enumerate(values) if x[0] == g]
        assert [got[i] for i in own] == probability.midranks([values[i][1] for i in own])
    at = {r.i: r.pos for r in ranking.positions(d, ["g"], ranking.range_of(F.col("v"), ranking.bounds(d, "v")), ["v", "i"]).collect()}
    assert all(at[i] == k for g in (0, 1) for k, i in enumerate(sorted((i for i, x in enumerate(values) if x[0] == g), key=lambda i: (values[i][1], i))))
    p = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(rng.random(500) ** 3)], "i int, g int, p double")
    by = sorted((r.p, r.i) for r in p.collect())
    want, most = {}, 0.0
    for k, (x, i) in enumerate(by):
        most = max(most, min(1.0, x * (500 - k)))
        want[i] = most
    assert {r.i: r.p_holm for r in statistics.holm(p, ["g"], "p").collect()} == pytest.approx(want)


def test_normaliser_hook(spark):
    """A batch that raises and what isn't valid are made once more alone; what fails again keeps its input."""
    rows = [(1, "one two three"), (2, "one two three"), (3, "short one"), (4, "bad text here"), (5, None), (6, "long " * 50), (7, "raise me please")]

    def load():
        seen = set()

        def model(texts):
            if len(texts) > 1 and any(t.startswith("raise") for t in texts):
                raise ValueError
            out = []
            for t in texts:
                out.append("" if t.startswith("bad") or t.startswith("short") and t not in seen else t.upper())
                seen.add(t)
            return out

        return model

    d = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: (r.norm, r.used) for r in inference.normalise(d, "t", load, batch=100).collect()}
    assert got[1] == got[2] == ("ONE TWO THREE", "retry") and got[7][1] == "retry" and got[4] == ("bad text here", "input") and got[5] == (None, None)
    got = {r.id: (r.norm, r.used) for r in inference.normalise(d.where("id <> 7"), "t", load, batch=2).collect()}
    assert got[1] == ("ONE TWO THREE", "made") and got[6][1] == "made" and got[4][1] == "input" and len(got) == 6


def test_alignment_holds_few_rows(spark):
    """A task gives rows as it goes: no batch of more than it may hold, whatever a batch of documents has, and the same distances."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessellex.operators import alignment

    docs = [(i, "x", [f"W{i % 7}", "same", f"U{j}"] * 5, [f"w{i % 7}", "same", f"u{j}"] * 5) for i, j in enumerate([3, 1, 2] * 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], ["doc_id", "lang", "raw", "norm"])
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("pos", pa.int64()), ("op", pa.string()), ("src", pa.string()), ("dst", pa.string())])
    given = lambda first, most: list(alignment.aligned_batches(iter([batch]), schema, 1, True, first, most))
    assert [b.num_rows for b in given(False, 20)] == [20] * 22 + [10] and all(b.num_rows <= 4 for b in given(True, 4))
    want = [r for d in docs for r in [(d[0], p, s, t) for _, p, s, t in alignment.aligned(d[2], d[3], True)]]
    assert [(r["doc_id"], r["pos"], r["src"], r["dst"]) for b in given(False, 20) for r in b.to_pylist()] == want
    firsts = lambda most: {s: min((r["doc_id"], r["pos"], r["dst"]) for b in given(True, most) for r in b.to_pylist() if r["src"] == s) for s in {x[2] for x in want}}
    assert firsts(4) == firsts(10**6) == {s: min((d, p, t) for d, p, x, t in want if x == s) for s in {x[2] for x in want}}
    d = spark.createDataFrame(docs, "doc_id long, lang string, raw array<string>, norm array<string>")
    assert alignment.align(d, keys=("lang",)).agg(F.count("*")).first()[0] == len(want)


def test_alignment_by_bounds_is_that_of_difflib():
    """Blocks found by bounds are difflib's, ties among them; and a long text with common words is searched a few times, not once a block."""
    import random

    from tessellex.operators import alignment

    def mapped(a, b, padded):
        ids: dict[str, int] = {}
        x, y = (np.array([ids.setdefault(w, len(ids)) for w in t], np.int32) for t in (a, b))
        target, op = alignment.mapped(x, y, padded, np.random.default_rng(0).integers(0, 1 << 64, len(ids), np.uint64))
        return [(alignment.OPERATIONS[o], i, a[i], b[t] if t >= 0 else "") for i, (t, o) in enumerate(zip(target.tolist(), op.tolist(), strict=True)) if t > -2]

    rnd = random.Random(3)
    for _ in range(400):
        a = [f"w{rnd.randrange(rnd.choice([2, 9, 80]))}" for _ in range(rnd.choice([0, 1, 7, 60, 230]))]
        a = a[: len(a) // 3] * 3 if rnd.random() < 0.3 else a
        b = [x if rnd.random() < 0.8 else rnd.choice([x + "s", "w1"]) for x in a]
        b = [x for x in b if rnd.random() < 0.95] if rnd.random() < 0.4 else b
        for padded in (False, True):
            assert mapped(a, b, padded) == list(alignment.aligned(a, b, padded))
    a = [w for i in range(100) for w in ("the", f"U{i}", "of", f"v{i}")]
    searched, longest = [], alignment.Sides.longest
    alignment.Sides.longest = lambda self, *r: searched.append(r) or longest(self, *r)
    try:
        assert mapped(a, [w.lower() for w in a], False) == list(alignment.aligned(a, [w.lower() for w in a], False))
    finally:
        alignment.Sides.longest = longest
    assert len(searched) < 50
    a = [f"w{i % 40}" for i in range(1500)]
    assert mapped(a, ["x", *a[7:900], "y", *a[900:]], False) == list(alignment.aligned(a, ["x", *a[7:900], "y", *a[900:]], False))
