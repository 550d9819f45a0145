"""Retrieval that skips pairs, against retrieval over all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import DATA

from tessellex.operators import postings
from tessellex.operators import retrieval as ir
from tessellex.queries import retrieval as qr

SF = str(DATA / "sf0.01")


def test_gold_ranks_without_pairs(spark):
    """The same ranks in one block and in many; the rows before the aggregate are a fifth of the pairs' at most, and not all postings are read."""
    q, p = qr.questions(spark, SF).cache(), qr.passages(spark, SF).cache()
    weights = ir.bm25_weights(p).cache()
    want = {r["qid"]: r["rank"] for r in ir.gold_ranks(q, ir.bm25_scores(q, weights), p.count()).collect()}
    pairs = q.select("qid", F.explode("tokens").alias("term")).distinct().join(weights, "term").count()
    for size in (postings.POSTINGS, 1500):
        rows = postings.block_counts(q, p, postings=size).cache()
        n, touched = rows.agg(F.count("*"), F.sum("touched")).first()
        assert n * 5 <= pairs and touched < pairs
        counts = {r["qid"]: r["n"] for r in rows.groupBy("qid").agg(F.sum("n").alias("n")).collect()}
        assert {i: counts.get(i, p.count()) for i in want} == want
    assert {r["qid"]: r["rank"] for r in postings.gold_ranks(q, p).collect()} == want


def test_gold_ranks_edges(spark):
    """A common word, ties, a repeated query word, a gold passage without the query's words, empty tokens, no passages."""
    docs = [(i, ["the", f"w{i % 5}", *(["rare"] if i in (3, 4) else [])]) for i in range(40)] + [(40, []), (41, ["alone"])]
    queries = [(0, 3, ["the", "rare", "the"]), (1, 7, ["the", "w2", "unseen"]), (2, 41, ["the"]), (3, 40, []), (4, 12, ["the"])]
    d, q = spark.createDataFrame(docs, "did long, tokens array<string>"), spark.createDataFrame(queries, "qid long, gold long, tokens array<string>")
    want = {r["qid"]: r["rank"] for r in ir.gold_ranks(q, ir.bm25_scores(q, ir.bm25_weights(d)), d.count()).collect()}
    assert {r["qid"]: r["rank"] for r in postings.gold_ranks(q, d).collect()} == want and want[2] == want[3] == 42 and want[4] == 38 and want[0] == 2
    assert {r["qid"]: r["rank"] for r in postings.gold_ranks(q, d.where("false")).collect()} == dict.fromkeys(range(5), 0)


def test_scores_without_a_shuffle_of_pairs(spark):
    """All pairs and their scores in one block and in many, cut anywhere; nothing groups pairs, and a block's ids may be strings."""
    q, p = qr.questions(spark, SF).cache(), qr.passages(spark, SF).cache()
    weights = ir.bm25_weights(p).cache()
    key = lambda d: {(r["qid"], r["did"]): r["score"] for r in d.collect()}
    want = key(ir.bm25_scores(q, weights))
    for size, cells, rows in ((postings.POSTINGS, postings.CELLS, postings.ROWS), (700, 1, 7), (700, 1000, 100)):
        assert key(postings.scores(q, weights, size, cells, rows)) == pytest.approx(want, abs=1e-9)
    plan = qr.q_bm25_scores(spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, below, _ = plan.partition("MapInArrow")
    assert below and "Exchange" not in above and "Aggregate" not in above
    assert key(postings.scores(q, weights.withColumn("did", F.concat(F.lit("d"), "did")), 700)) == pytest.approx({(a, f"d{b}"): s for (a, b), s in want.items()}, abs=1e-9)
    assert not key(postings.scores(q.where("false"), weights)) and not key(postings.scores(q, weights.where("false")))


def test_dense_top1_travels_a_bounded_number_of_times(spark, monkeypatch):
    """Blocks a side don't grow with the vectors until these are a million, and tiles and ties give what one product gives."""
    assert [ir.block_count(n) for n in (0, 5000, 65_536, 615_384, 1 << 20, 1 << 22)] == [1, 2, 16, 16, 16, 64]
    monkeypatch.setattr(ir, "TILE", 7)
    v = np.random.default_rng(2).integers(-1, 2, size=(150, 3)).astype(float)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid long, vector array<double>")
    got = {r["qid"]: (r["did"], str(r["sim"])) for r in ir.dense_top1(d, d.withColumnRenamed("qid", "did")).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -np.inf)
    assert got == {i: (int(s.argmax()), str(s.max())) for i, s in enumerate(sim)}


@pytest.mark.parametrize("n_queries, n_pool", [(300, 10), (10, 300), (300, 200)])
def test_dense_top1_blocks(spark, n_queries, n_pool):
    """Each query has its answer however many blocks the two sides have, also if one has a single block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = np.random.default_rng(1).normal(size=(n_queries + n_pool, 4))
        q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:n_queries])], "qid long, vector array<double>")
        p = spark.createDataFrame([(1000 + i, x.tolist()) for i, x in enumerate(v[n_queries:])], "did long, vector array<double>")
        got = {r["qid"]: r["did"] for r in ir.dense_top1(q, p, block=32).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {i: 1000 + int(k) for i, k in enumerate((u[:n_queries] @ u[n_queries:].T).argmax(axis=1))}


def test_a_block_answers_queries_together(spark):
    """Common terms (a matrix), rare ones, repeated words, ties and unknown words, for several queries at once, against all scores."""
    rng = np.random.default_rng(3)
    held = rng.random((200, 12)) < np.linspace(0.9, 0.02, 12)
    held[:2] = True
    w = np.where(held, rng.integers(1, 5, held.shape) / 4, 0.0)
    rows = [(0, int(d), f"t{t:02}", float(w[d, t])) for d, t in zip(*np.nonzero(held), strict=True)]
    batch = postings.posting_blocks(spark.createDataFrame(rows, "block int, did long, term string, w double"), 1).toArrow().to_batches()[0]
    block = postings.Postings(batch, 0)
    assert 0 < len(block.rows) < 12
    asked = [(rng.choice(12, 4, replace=False), rng.integers(1, 3, 4)) for _ in range(40)]
    scores = [w[:, t] @ c for t, c in asked]
    for at in (0, 100):
        queries = [([*(f"t{x:02}" for x in t), "no"], [*c.tolist(), 1], float(np.sort(s)[::-1][at]) or 0.25) for (t, c), s in zip(asked, scores, strict=True)]
        assert [n for n, _ in block.at_least(queries)] == [int((s >= q[2]).sum()) for s, q in zip(scores, queries, strict=True)]


def test_scores_copy_no_query_for_a_block(spark):
    """Queries and blocks are read by tasks in pairs; neither side is shuffled once for each row of the other."""
    plan = qr.q_bm25_scores(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Sort" not in plan
