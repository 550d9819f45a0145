"""BM25 over conversations (query: a user turn, gold: the assistant turn after it) and dense retrieval over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex.functions import text
from tessellex.operators import postings, resampling
from tessellex.operators import retrieval as ir
from tessellex.sources import table

from . import query
from .texts import TOKENS

TOK = {"tok": TOKENS, "low": TOKENS.replace("text", "lower(text)"), "cut": f"list_transform({TOKENS.replace('text', 'lower(text)')}, lambda x: left(x, 4))"}


def tokens(condition: str):
    t = text.tokenize(F.col("text") if condition == "tok" else F.lower("text"))
    return F.transform(t, lambda x: F.left(x, F.lit(4))) if condition == "cut" else t


def passages(spark, sf_dir, condition="tok"):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("did"), tokens(condition).alias("tokens"))


def questions(spark, sf_dir, condition="tok"):
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), tokens(condition).alias("tokens"))
    gold = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("gold"))
    return q.withColumn("gold", F.col("qid") + 1).join(gold, "gold")


def sql(condition: str = "tok", k1: float = 0.9, b: float = 0.4) -> str:
    """CTEs p, q, w (weights) and s (scores)."""
    t = TOK[condition]
    return f"""p AS (SELECT conv_id * 1000 + turn AS did, {t} AS tokens FROM conversations WHERE role = 'assistant'),
q AS (SELECT c.qid, c.qid + 1 AS gold, c.tokens FROM (SELECT conv_id * 1000 + turn AS qid, {t} AS tokens FROM conversations WHERE role = 'user') c JOIN p p2 ON p2.did = c.qid + 1),
tf AS (SELECT did, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT did, tokens, unnest(tokens) AS term FROM p) GROUP BY did, len(tokens), term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), g AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens))::DOUBLE AS avgdl FROM p),
w AS (SELECT did, tf.term, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df ON tf.term = df.term, g),
s AS (SELECT qid, did, round(sum(w), 9) AS score FROM (SELECT qid, unnest(tokens) AS term FROM q) qt JOIN w ON w.term = qt.term GROUP BY qid, did)"""


def rank_sql(condition: str = "tok", k1: float = 0.9, b: float = 0.4) -> str:
    return f"""WITH {sql(condition, k1, b)}, gs AS (SELECT q.qid, coalesce(s.score, 0) AS g FROM q LEFT JOIN s ON s.qid = q.qid AND s.did = q.gold)
SELECT gs.qid, CASE WHEN g > 0 THEN (SELECT count(*) FROM s WHERE s.qid = gs.qid AND s.score >= gs.g) ELSE (SELECT count(*) FROM p) END::BIGINT AS rank FROM gs"""


def ranks(spark, sf_dir, condition="tok", k1=0.9, b=0.4):
    return postings.gold_ranks(questions(spark, sf_dir, condition), passages(spark, sf_dir, condition), k1, b)


@query(f"WITH {sql()} SELECT did, term, tf::BIGINT AS tf, round(w, 6) AS w FROM w")
def q_bm25_weights(spark, sf_dir):
    return ir.bm25_weights(passages(spark, sf_dir)).select("did", "term", "tf", F.round("w", 6).alias("w"))


def rounded_up(c, digits: int):
    """A number from 0 rounded as SQL rounds doubles, half up: for very many rows, since Spark's own goes through decimals."""
    x = c * F.lit(10.0**digits)
    return (F.floor(x) + (x - F.floor(x) >= 0.5).cast("int")) / F.lit(10.0**digits)


@query(f"WITH {sql()} SELECT qid, did, round(score, 4) AS score FROM s")
def q_bm25_scores(spark, sf_dir):
    return postings.scores(questions(spark, sf_dir), ir.bm25_weights(passages(spark, sf_dir))).select("qid", "did", rounded_up(rounded_up(F.col("score"), 9), 4).alias("score"))


METRICS = "round(avg((rank = 1)::INT), 6) AS r1, round(avg((rank <= 10)::INT), 6) AS r10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr10, round(avg(rank), 6) AS mean_rank"
GRID = [(0.9, 0.4), (1.2, 0.75)]


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(" UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, {METRICS} FROM ({rank_sql('tok', k1, b)})" for k1, b in GRID))
def q_bm25_grid(spark, sf_dir):
    out = None
    for k1, b in GRID:
        r = ranks(spark, sf_dir, "tok", k1, b).withColumns({"k1": F.lit(k1), "b": F.lit(b)})
        out = r if out is None else out.unionByName(r)
    return rounded(ir.ir_metrics(out, ["k1", "b"]))


@query(rank_sql())
def q_gold_rank(spark, sf_dir):
    return ranks(spark, sf_dir)


@query(f"SELECT {METRICS} FROM ({rank_sql()})")
def q_ir_metrics(spark, sf_dir):
    return rounded(ir.ir_metrics(ranks(spark, sf_dir), []))


@query(f"WITH {sql()} SELECT count(*)::BIGINT AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = q.qid)")
def q_no_terms(spark, sf_dir):
    q, p = questions(spark, sf_dir), passages(spark, sf_dir)
    seen = q.select("qid", F.explode("tokens").alias("term")).join(p.select(F.explode("tokens").alias("term")).distinct(), "term", "left_semi")
    return q.join(seen, "qid", "left_anti").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS condition, qid, rank FROM ({rank_sql(c)})" for c in TOK))
def q_conditions(spark, sf_dir):
    out = None
    for c in TOK:
        r = ranks(spark, sf_dir, c).withColumn("condition", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out.select("condition", "qid", "rank")


@query("SELECT a AS base, b AS other FROM (VALUES ('tok'), ('low'), ('cut')) x(a), (VALUES ('tok'), ('low'), ('cut')) y(b) WHERE a < b")
def q_condition_pairs(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in TOK], "c string")
    return c.alias("a").join(c.alias("b"), F.col("a.c") < F.col("b.c")).select(F.col("a.c").alias("base"), F.col("b.c").alias("other"))


RR = "CASE WHEN {r} <= 10 THEN 1.0::DOUBLE / {r} ELSE 0 END"


@query(f"""SELECT round(avg({RR.format(r='b.rank')}) - avg({RR.format(r='a.rank')}), 6) AS delta_mrr10, round(avg((b.rank = 1)::INT) - avg((a.rank = 1)::INT), 6) AS delta_r1,
(count(*) FILTER (WHERE a.rank = 1 AND b.rank <> 1))::BIGINT AS a_only, (count(*) FILTER (WHERE a.rank <> 1 AND b.rank = 1))::BIGINT AS b_only
FROM ({rank_sql('tok')}) a JOIN ({rank_sql('cut')}) b ON a.qid = b.qid""")
def q_ir_compare(spark, sf_dir):
    j = ranks(spark, sf_dir, "tok").join(ranks(spark, sf_dir, "cut").withColumnRenamed("rank", "other"), "qid")
    rr = lambda c: F.when(F.col(c) <= 10, 1 / F.col(c)).otherwise(0.0)
    one = lambda c: (F.col(c) == 1).cast("double")
    return j.agg(
        F.round(F.avg(rr("other")) - F.avg(rr("rank")), 6).alias("delta_mrr10"), F.round(F.avg(one("other")) - F.avg(one("rank")), 6).alias("delta_r1"),
        F.count(F.when((F.col("rank") == 1) & (F.col("other") != 1), 1)).alias("a_only"), F.count(F.when((F.col("rank") != 1) & (F.col("other") == 1), 1)).alias("b_only"),
    )


def delta_sql(k1: float, b: float) -> str:
    return f"(SELECT avg({RR.format(r='b.rank')}) - avg({RR.format(r='a.rank')}) AS d FROM ({rank_sql('tok', k1, b)}) a JOIN ({rank_sql('cut', k1, b)}) b ON a.qid = b.qid)"


@query(f"SELECT round(x.d, 6) AS primary_delta, round(y.d, 6) AS other_delta, (x.d > 0) = (y.d > 0) AS same_sign FROM {delta_sql(*GRID[0])} x, {delta_sql(*GRID[1])} y")
def q_sign_stability(spark, sf_dir):
    rr = lambda c: F.when(F.col(c) <= 10, 1 / F.col(c)).otherwise(0.0)
    d = [ranks(spark, sf_dir, "tok", *g).join(ranks(spark, sf_dir, "cut", *g).withColumnRenamed("rank", "o"), "qid").agg((F.avg(rr("o")) - F.avg(rr("rank"))).alias(f"d{i}"), F.lit(1).alias("one")) for i, g in enumerate(GRID)]
    return d[0].join(d[1], "one").select(F.round("d0", 6).alias("primary_delta"), F.round("d1", 6).alias("other_delta"), ((F.col("d0") > 0) == (F.col("d1") > 0)).alias("same_sign"))


@query("""SELECT u.conv_id, u.turn, min(d.conv_id * 1000 + d.turn) AS gold FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
JOIN conversations d ON d.role = 'assistant' AND d.text = a.text WHERE u.role = 'user' GROUP BY u.conv_id, u.turn""")
def q_gold(spark, sf_dir):
    """The gold passage by its text, the first one of equal passages."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'")
    first = a.groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("gold"))
    u = c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("next"))
    return u.join(a.select("conv_id", F.col("turn").alias("next"), "text"), ["conv_id", "next"]).join(first, "text").select("conv_id", "turn", "gold")


# --- dense ----------------------------------------------------------------------------------------

VECTORS = {
    "full": "list_transform(embedding, lambda x: x::DOUBLE)",
    "sign": "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN -1.0 ELSE 0.0 END::DOUBLE)",
}


def top_sql(kind: str) -> str:
    v = f"(SELECT vec_id, label, {VECTORS[kind]} AS v FROM embeddings)"
    return f"""SELECT qid, label, bl AS found, bid AS did, s AS sim FROM (SELECT a.vec_id AS qid, a.label, b.vec_id AS bid, b.label AS bl, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS k
FROM {v} a JOIN {v} b ON a.vec_id <> b.vec_id, LATERAL (SELECT round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s)) WHERE k = 1"""


def top1(spark, sf_dir, kind):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double") if kind == "full" else F.signum(x.cast("double")))
    q = e.select(F.col("vec_id").alias("qid"), v.alias("vector"))
    top = ir.dense_top1(q, q.withColumnRenamed("qid", "did"))
    names = e.select(F.col("vec_id").alias("did"), F.col("label").alias("found"))
    return top.join(names, "did").join(e.select(F.col("vec_id").alias("qid"), "label"), "qid").select("qid", "label", "found", "did", "sim")


@query(f"SELECT qid, did, label = found AS correct, round(sim, 6) AS sim FROM ({top_sql('full')})")
def q_dense_top1(spark, sf_dir):
    return top1(spark, sf_dir, "full").select("qid", "did", (F.col("label") == F.col("found")).alias("correct"), F.round("sim", 6).alias("sim"))


RECALL = f"""SELECT x.label, round(avg((x.label = x.found)::INT), 6) AS r1_raw, round(avg((y.label = y.found)::INT), 6) AS r1_sign,
round(avg((y.label = y.found)::INT) - avg((x.label = x.found)::INT), 6) AS delta FROM ({top_sql('full')}) x JOIN ({top_sql('sign')}) y ON x.qid = y.qid GROUP BY x.label"""


def recall(spark, sf_dir):
    x = top1(spark, sf_dir, "full").select("qid", "label", (F.col("label") == F.col("found")).cast("double").alias("a"))
    y = top1(spark, sf_dir, "sign").select("qid", (F.col("label") == F.col("found")).cast("double").alias("b"))
    return x.join(y, "qid").groupBy("label").agg(F.round(F.avg("a"), 6).alias("r1_raw"), F.round(F.avg("b"), 6).alias("r1_sign"), F.round(F.avg("b") - F.avg("a"), 6).alias("delta"))


@query(RECALL)
def q_dense_recall(spark, sf_dir):
    return recall(spark, sf_dir)


@query(f"SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE r1_raw >= 0.1))::BIGINT AS competent, round(avg(delta) FILTER (WHERE r1_raw >= 0.1), 5) AS delta FROM ({RECALL})")
def q_competence(spark, sf_dir):
    """Groups with a recall of at least 0.1 on raw vectors count."""
    ok = F.col("r1_raw") >= 0.1
    return recall(spark, sf_dir).agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("competent"), F.round(F.avg(F.when(ok, F.col("delta"))), 5).alias("delta"))


@query(f"""SELECT d.label, delta, n.n FROM ({RECALL}) d LEFT JOIN (SELECT label, count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label HAVING count(*) > 14) n ON d.label = n.label""")
def q_dense_vs_sparse(spark, sf_dir):
    """Two results by one key; a key that the second one lacks gets null."""
    n = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").groupBy("label").agg(F.count("*").alias("n")).where("n > 14")
    return recall(spark, sf_dir).select("label", "delta").join(n, "label", "left")


RANKED = f"SELECT 'tok' AS condition, qid AS item, {RR.format(r='rank')} AS v FROM ({rank_sql()})"


@query(f"SELECT b.condition, n, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi FROM ({resampling.bootstrap_sql(RANKED, 'condition')}) b JOIN (SELECT condition, count(*)::BIGINT AS n, avg(v) AS mean FROM ({RANKED}) GROUP BY condition) m ON m.condition = b.condition")
def q_bootstrap_mrr(spark, sf_dir):
    """The interval of the mean reciprocal rank from 10,000 replicates."""
    r = ranks(spark, sf_dir).select(F.lit("tok").alias("condition"), "qid", F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0).alias("rr"))
    return resampling.bootstrap(r, ["condition"], "rr", "qid").select("condition", "n", *[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")])
