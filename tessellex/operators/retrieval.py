"""Lexical and dense retrieval: BM25 as joins and aggregates, top-1 by blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bm25_weights(docs: DataFrame, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """did, term, tf, w from did and tokens (an array). The mean length counts empty documents too."""
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).head()
    avgdl = total / n if n else 1.0
    tf = docs.select("did", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("did", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
    return tf.join(df, "term").select("did", "term", "tf", (idf * norm).alias("w"))


def bm25_scores(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """qid, did, score of the pairs that share a term; all others score 0. queries: qid, tokens."""
    q = queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    return q.join(weights, "term").groupBy("qid", "did").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def gold_ranks(queries: DataFrame, scores: DataFrame, n_docs: int, digits: int = 9) -> DataFrame:
    """qid, rank: how many documents score as high as the gold one or higher. queries: qid, gold. A gold score of 0 ranks last."""
    gold = queries.select("qid", "gold")
    s = scores.join(gold, "qid").select("qid", F.round("score", digits).alias("score"), (F.col("did") == F.col("gold")).alias("hit"))
    g = F.max(F.when(F.col("hit"), F.col("score"))).over(Window.partitionBy("qid"))
    above = s.withColumn("g", g).where((F.col("score") >= F.col("g")) & (F.col("g") > 0)).groupBy("qid").agg(F.count("*").alias("n"))
    return gold.join(above, "qid", "left").select("qid", F.coalesce("n", F.lit(n_docs)).cast("long").alias("rank"))


def ir_metrics(ranks: DataFrame, keys: list[str]) -> DataFrame:
    r = F.col("rank")
    return ranks.groupBy(*keys).agg(
        F.avg((r == 1).cast("double")).alias("r1"), F.avg((r <= 10).cast("double")).alias("r10"),
        F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr10"), F.avg(r.cast("double")).alias("mean_rank"),
    )


#: Vectors of a block of top-1, if there are few; for more of them, BLOCKS blocks a side, until these hold MOST vectors each.
BLOCK, BLOCKS, MOST = 4096, 16, 1 << 16
#: Rows of each side whose products are in hand at once.
TILE = 2048


def block_count(n: int, block: int = BLOCK) -> int:
    """The number of blocks of n vectors. Each vector travels once a block of the other side: BLOCKS times at most up to BLOCKS * MOST vectors."""
    return max(1, min(-(-n // block), max(BLOCKS, -(-n // MOST))))


def dense_top1(queries: DataFrame, pool: DataFrame, block: int = BLOCK) -> DataFrame:
    """qid, did, sim: the most similar of pool (did, vector) for each query (qid, vector), cosine, the least did on ties.

    Both sides are cut into block_count() blocks; each pair of blocks is a task's matrix products, tile by tile, and only the
    best of a block leaves it. A query doesn't find the vector of its own id.
    """
    qn, pn = (block_count(df.count(), block) for df in (queries, pool))
    # one type a key on both sides: a cogroup deals an int and a long of one value to different tasks
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("qid", F.col("vector").alias("qv"), of("qid", qn).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(pn - 1))).alias("j"))
    p = pool.select("did", F.col("vector").alias("pv"), of("did", pn).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(qn - 1))).alias("i"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "did": [], "sim": []}).astype({"qid": "int64", "did": "int64"})
        b = b.sort_values("did")
        x, y = (np.stack(v.tolist()).astype(np.float64) for v in (a.qv, b.pv))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30) for v in (x, y))
        qid, did = a.qid.to_numpy(), b.did.to_numpy()
        found, sims = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
        for r in range(0, len(x), TILE):
            for c in range(0, len(y), TILE):
                sim = x[r : r + TILE] @ y[c : c + TILE].T
                sim[qid[r : r + TILE, None] == did[c : c + TILE]] = -np.inf
                most, row = sim.max(axis=1), np.arange(len(sim))
                # the first of those that round to the most is mostly the first that is near it
                k, top = (sim >= most[:, None] - 2e-9).argmax(axis=1), np.round(most, 9)
                unsure = np.round(sim[row, k], 9) != top
                k[unsure] = np.round(sim[unsure], 9).argmax(axis=1)
                # on ties the tile before has the lesser did; within a block NaN is above all, as argmax has it
                better = (top > sims[r : r + TILE]) | (np.isnan(top) & ~np.isnan(sims[r : r + TILE]))
                sims[r : r + TILE][better], found[r : r + TILE][better] = top[better], k[better] + c
        return pd.DataFrame({"qid": qid, "did": did[found], "sim": sims})

    top = q.groupBy("i", "j").cogroup(p.groupBy("i", "j")).applyInPandas(best, "qid long, did long, sim double")
    return top.groupBy("qid").agg(F.max(F.struct("sim", (-F.col("did")).alias("n"))).alias("m")).select("qid", (-F.col("m.n")).alias("did"), F.col("m.sim").alias("sim"))
