"""BLEU, cross-validated generators and headings of ordered lines, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import DATA

from tessellex.functions import probability
from tessellex.operators import generation, sequences
from tessellex.plans import NormalizationStudy
from tessellex.queries import QUERIES
from tessellex.queries.studies import DIMENSIONS

SF = str(DATA / "sf0.001")


def bleu(pairs):
    """Of a corpus of (made, reference) token lists."""
    hits, totals = [0] * 4, [0] * 4
    for made, reference in pairs:
        for n in range(1, 5):
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (made, reference))
            hits[n - 1] += sum((a & b).values())
            totals[n - 1] += sum(a.values())
    c, r = sum(len(m) for m, _ in pairs), sum(len(x) for _, x in pairs)
    if not all(totals):
        return 0.0
    share, logs = 1.0, []
    for h, t in zip(hits, totals, strict=True):
        if not h:
            share /= 2
        logs.append(math.log((h or share) / t))
    return 100 * (1.0 if c >= r else math.exp(1 - r / c)) * math.exp(sum(logs) / 4)


def test_bleu(spark):
    """Clipping, brevity, orders without hits and without n-grams, empty and null sides, repeated words in long texts; one corpus and several."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, k, m := text(rng.randint(0, 40)), m[: rng.randint(0, 40)] + text(rng.randint(0, 15))) for i, k in enumerate("aabbb" * 8)]
    rows += [(100, "the", ["the"] * 7, ["the", "cat", "is", "on", "the", "mat"]), (101, "short", ["a", "b"], ["a", "b"]), (102, "none", [], ["x"]), (103, "null", None, None), (104, "long", ["x", "y"] * 3000, ["x", "y", "z"] * 2000)]
    df = spark.createDataFrame(rows, "i int, k string, made array<string>, reference array<string>")
    counts = generation.bleu_counts(df, ["k"], "i", "made", "reference")
    got = {r["k"]: r["b"] for r in counts.select("k", generation.bleu(counts).alias("b")).collect()}
    by = {}
    for _, k, m, r in rows:
        by.setdefault(k, []).append((m or [], r or []))
    assert got == pytest.approx({k: bleu(p) for k, p in by.items()}, abs=1e-9)
    every = generation.bleu_counts(df, [], "i", "made", "reference")
    assert every.select(generation.bleu(every)).first()[0] == pytest.approx(bleu([p for x in by.values() for p in x]))
    # sums of parts are the sums of the whole
    parts = counts.agg(*[F.sum(c).alias(c) for c in ("made_length", "reference_length")], *[F.sum(F.get(c, F.lit(n))).alias(f"{c}{n}") for c in ("hits", "totals") for n in range(4)]).first()
    whole = every.first()
    assert [parts[f"hits{n}"] for n in range(4)] == whole["hits"] and parts["made_length"] == whole["made_length"]


def test_bleu_shuffles_numbers(spark):
    """A text's n-grams are counted where it is: none is a row, and nothing is joined."""
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "b"]), (2, None, ["c"])], "i int, made array<string>, reference array<string>")
    counts = generation.bleu_counts(df, [], "i", "made", "reference")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert counts.select("made_length", "reference_length", "hits", "totals").first() == (3, 3, [2, 1, 0, 0], [3, 2, 1, 0])


def test_generators(spark):
    """A generator that knows the training side's last words; each item is made by the fold that hasn't seen it."""
    rows = [(i, f"Text {i} ends", f"text {i} ends", f"text {i} ends so") for i in range(12)]
    study = NormalizationStudy(spark.createDataFrame(rows, "doc_id long, raw string, norm string, label string"))
    sizes = []

    def generate(train, test):
        sizes.append((train.count(), test.count(), train.join(test, "item").count()))
        return test.select("item", F.concat("text", F.lit(" so")).alias("made"))

    r = study.generative(generate).first()
    assert set(sizes) == {(8, 4, 0)} and len(sizes) == 6
    assert r["score_norm"] == pytest.approx(1) and r["score_raw"] == pytest.approx(0.75) and r["delta"] == pytest.approx(0.25)
    assert study.generative(generate, metric="bleu").first()["score_norm"] == pytest.approx(100)


def test_last_known(spark):
    """Pieces of any size give the same values; null keys are a key."""
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, None, None, f"{k}{i}"]), rng.choice([None] * 9 + [i])) for k in ("a", None, "b") for i in range(60)]
    want, a, b, of = {}, None, None, object()
    for k, i, x, y in rows:
        if k != of:
            a, b, of = None, None, k
        a, b = x if x is not None else a, y if y is not None else b
        want[k, i] = (a, b)
    df = spark.createDataFrame(rows, "k string, i long, x string, y int").repartition(5)
    for piece in (1, 7, 1000):
        assert {(r["k"], r["i"]): (r["x"], r["y"]) for r in sequences.last_known(df, ["k"], "i", ["x", "y"], piece).collect()} == want


def test_rows_of_latex_tables(spark):
    body = r"""\midrule
\multicolumn{4}{l}{\textit{First}} \\
\multirow{2}{*}{Group A} & 1.5 & $-2$ & x \\
 & 3 & 4 & y \\
\cmidrule{1-4}
\multicolumn{4}{l}{\textit{Second}} \\
 & 5 & 6 & z \\
\multirow{1}{*}{B}
 & 7 & & \\"""
    lines = [(1, i, t) for i, t in enumerate(body.split("\n"))]
    got = sequences.table_rows(spark.createDataFrame(lines, "d int, line long, t string"), ["d"], "line", "t").orderBy("line").collect()
    assert [(r["section"], r["group"], r["cells"]) for r in got] == [
        ("First", "Group A", ["", "1.5", "$-2$", "x"]), ("First", "Group A", ["", "3", "4", "y"]), ("Second", "Group A", ["", "5", "6", "z"]), ("Second", "B", ["", "7", "", ""]),
    ]


def test_dimensions(spark):
    tier = QUERIES["q_tier_b"](spark, SF).toPandas()
    got = {(r["dim_a"], r["dim_b"]): (r["n"], r["rho"], r["p"]) for r in QUERIES["q_dimensions"](spark, SF).collect()}
    assert len(got) == 10
    for a, b in got:
        x, y = (probability.midranks(tier[c].tolist()) for c in (a, b))
        rho = np.corrcoef(x, y)[0, 1]
        assert a < b and {a, b} <= set(DIMENSIONS) and got[a, b] == pytest.approx((len(tier), rho, probability.spearman_p(rho, len(tier))), abs=2e-6)
