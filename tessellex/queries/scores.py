"""Efficiency scores and embedding-based retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex.operators import ranking
from tessellex.operators import vocabulary as vo
from tessellex.sources import table

from . import SQL, query
from .texts import q_cr, q_cr_decomposition, q_kl, vocabulary_sql

# the sign vector of an embedding stands for a normalised text's embedding
E = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN -1.0 ELSE 0.0 END::DOUBLE) AS s FROM embeddings"
COS = "list_dot_product(e, s) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(s, s)))"


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.transform("embedding", lambda x: F.signum(x.cast("double"))).alias("s"))


@query(f"SELECT label, round(avg({COS}), 6) AS irs, count(*)::BIGINT AS n FROM ({E}) GROUP BY label")
def q_irs(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("label").agg(F.round(F.avg(vo.cosine(F.col("e"), F.col("s"))), 6).alias("irs"), F.count("*").alias("n"))


IRS = f"SELECT round(avg({COS}), 6) AS irs FROM ({E})"
SCORED = f"SELECT lang, cr, CASE WHEN cr < 1 THEN 0 ELSE 1 - 1 / cr END AS vrg, irs FROM (SELECT lang, v_raw::DOUBLE / v_ortho AS cr FROM ({vocabulary_sql('lang')})), ({IRS})"


def scored(spark, sf_dir):
    irs = pairs(spark, sf_dir).agg(F.round(F.avg(vo.cosine(F.col("e"), F.col("s"))), 6)).head()[0]  # one number
    cr = F.col("v_raw") / F.col("v_ortho")
    return q_cr(spark, sf_dir).select("lang", cr.alias("cr"), vo.vrg(cr).alias("vrg"), F.lit(irs).alias("irs"))


@query(f"SELECT lang, round(vrg, 6) AS vrg, irs, round(2 * irs * vrg / (irs + vrg), 6) AS aes FROM ({SCORED})")
def q_aes(spark, sf_dir):
    return scored(spark, sf_dir).select("lang", F.round("vrg", 6).alias("vrg"), "irs", F.round(vo.aes(F.col("irs"), F.col("vrg")), 6).alias("aes"))


BETAS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0]
BETA_SQL = f"SELECT lang, beta, round((1 + beta * beta) * irs * vrg / (beta * beta * irs + vrg), 6) AS score FROM ({SCORED}), (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0]::DOUBLE[]) AS beta)"


def swept(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("beta", F.explode(F.array(*map(F.lit, BETAS))))
    return s.select("lang", "beta", F.round(vo.aes(F.col("irs"), F.col("vrg"), F.col("beta")), 6).alias("score"))


@query(BETA_SQL)
def q_aes_beta(spark, sf_dir):
    return swept(spark, sf_dir)


@query(f"SELECT beta, arg_max(lang, score) AS winner, max(score) AS score FROM ({BETA_SQL}) GROUP BY beta")
def q_sweep_winner(spark, sf_dir):
    return swept(spark, sf_dir).groupBy("beta").agg(F.max_by("lang", "score").alias("winner"), F.max("score").alias("score"))


@query("""SELECT v / 20.0::DOUBLE AS vrg, c / 10.0::DOUBLE AS level, CASE WHEN 2 * (v / 20.0::DOUBLE) > c / 10.0::DOUBLE THEN round((c / 10.0::DOUBLE) * (v / 20.0::DOUBLE) / (2 * (v / 20.0::DOUBLE) - c / 10.0::DOUBLE), 6) END AS irs
FROM (SELECT unnest(range(0, 21)) AS v), (SELECT unnest(range(1, 10)) AS c)""")
def q_iso(spark, sf_dir):
    """Lines of equal score: IRS for a gain at a level, null where there is none."""
    g = spark.range(21).select((F.col("id") / 20.0).alias("vrg"), F.explode(F.array(*[F.lit(c / 10) for c in range(1, 10)])).alias("level"))
    v, c = F.col("vrg"), F.col("level")
    return g.withColumn("irs", F.when(2 * v > c, F.round(c * v / (2 * v - c), 6)))


@query(f"""SELECT label, round(avg(d), 6) AS mean_error, round(max(d), 6) AS max_error, max(d) < 1e-4 AS ok FROM (
SELECT label, abs({COS} - list_dot_product(r, s) / (sqrt(list_dot_product(r, r)) * sqrt(list_dot_product(s, s)))) AS d FROM (SELECT *, list_transform(e, lambda x: floor(x * 256 + 0.5) / 256) AS r FROM ({E}))) GROUP BY label""")
def q_precision_check(spark, sf_dir):
    """What rounding to 8 bits after the point does to the cosine."""
    p = pairs(spark, sf_dir).withColumn("r", F.transform("e", lambda x: F.floor(x * 256 + 0.5).cast("double") / 256))
    d = F.abs(vo.cosine(F.col("e"), F.col("s")) - vo.cosine(F.col("r"), F.col("s")))
    return p.groupBy("label").agg(F.round(F.avg(d), 6).alias("mean_error"), F.round(F.max(d), 6).alias("max_error"), (F.max(d) < 1e-4).alias("ok"))


@query(f"""WITH n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM ({E}))
SELECT a.vec_id, len(a.u)::BIGINT * 4 AS n_features, round(list_sum(list_transform(range(1, len(a.u) + 1), lambda i: abs(a.u[i] - b.u[i]))), 6) AS l1, round(list_dot_product(a.u, b.u), 6) AS dot
FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def q_infersent(spark, sf_dir):
    """Features (u, v, |u - v|, u v) of a pair of unit vectors; here of neighbours by id."""
    n = pairs(spark, sf_dir).select("vec_id", vo.l2(F.col("e")).alias("u"))
    j = n.join(n.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")
    f = j.withColumns({"d": F.zip_with("u", "v", lambda a, b: F.abs(a - b)), "m": F.zip_with("u", "v", lambda a, b: a * b)})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return f.select("vec_id", F.size(F.concat("u", "v", "d", "m")).cast("long").alias("n_features"), F.round(total(F.col("d")), 6).alias("l1"), F.round(total(F.col("m")), 6).alias("dot"))


DIMS = ["cr_total", "cr_ortho", "cr_morph", "morph_share", "kl"]


@query(f"""WITH b AS (SELECT v.lang, [round(v_raw::DOUBLE / v_full, 6), round(v_raw::DOUBLE / v_ortho, 6), round(v_ortho::DOUBLE / v_full, 6), round(ln(v_ortho::DOUBLE / v_full) / ln(v_raw::DOUBLE / v_full), 6), k.kl] AS d
FROM ({vocabulary_sql('lang')}) v JOIN ({SQL['q_kl']}) k ON k.lang = v.lang),
l AS (SELECT lang, {DIMS}[i] AS dim, d[i] AS v FROM b, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
r AS (SELECT lang, dim, rank() OVER (PARTITION BY dim ORDER BY v) + (count(*) OVER (PARTITION BY dim, v) - 1) / 2.0::DOUBLE AS r FROM l)
SELECT a.dim AS dim_a, b.dim AS dim_b, count(*)::BIGINT AS n, round(corr(a.r, b.r), 6) + 0.0 AS rho FROM r a JOIN r b ON a.lang = b.lang AND a.dim < b.dim GROUP BY a.dim, b.dim""")
def q_dim_pairs(spark, sf_dir):
    """Rank correlations of all pairs of five dimensions over languages."""
    long = q_cr_decomposition(spark, sf_dir).join(q_kl(spark, sf_dir), "lang").unpivot("lang", DIMS, "dim", "v")
    long = ranking.midranks(long, ["dim"], "v", "r")
    j = long.alias("a").join(long.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.dim") < F.col("b.dim")))
    return j.groupBy(F.col("a.dim").alias("dim_a"), F.col("b.dim").alias("dim_b")).agg(F.count("*").alias("n"), (F.round(F.corr("a.r", "b.r"), 6) + 0.0).alias("rho"))
