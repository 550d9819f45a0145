"""Cross-validated learning and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex.functions import text
from tessellex.operators import inference, resampling
from tessellex.operators import learning as ml
from tessellex.operators import statistics as st
from tessellex.sources import spread, table
from tessellex.sources.scratch import materialize

from . import query
from .texts import SHORT_OUT, TOKENS, VALID

K = 5
FOLD = f"(row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % {K}"


def folds(spark, sf_dir):
    return ml.stratified_folds(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("label")), "item", "label", K)


@query(f"SELECT doc_id AS item, quality AS label, ({FOLD})::INT AS fold FROM labels")
def q_folds(spark, sf_dir):
    return folds(spark, sf_dir)


def counts(spark, sf_dir, cut: int | None = None):
    t = text.tokenize(F.lower("text"))
    t = F.transform(t, lambda x: F.left(x, F.lit(cut))) if cut else t
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("item"), F.explode(t).alias("term"))
    return d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item")), "item", "left_semi").groupBy("item", "term").agg(F.count("*").alias("tf"))


def counts_sql(cut: int | None = None) -> str:
    term = f"left(term, {cut})" if cut else "term"
    return f"""f AS (SELECT doc_id AS item, quality AS label, {FOLD} AS fold FROM labels),
tf AS (SELECT item, {term} AS term, count(*) AS tf FROM (SELECT doc_id AS item, unnest({TOKENS.replace('text', 'lower(text)')}) AS term FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY item, {term})"""


@query(f"""WITH {counts_sql()}, n AS (SELECT count(*)::DOUBLE AS n FROM f WHERE fold <> 0), df AS (SELECT term, count(*) AS df FROM tf WHERE item IN (SELECT item FROM f WHERE fold <> 0) GROUP BY term),
w AS (SELECT item, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, n), s AS (SELECT item, sqrt(sum(w * w)) AS s FROM w GROUP BY item)
SELECT w.item, term, round(w / s, 6) AS w FROM w JOIN s ON w.item = s.item""")
def q_tfidf(spark, sf_dir):
    """Weights of all items by the training side of fold 0."""
    return ml.tfidf(counts(spark, sf_dir), folds(spark, sf_dir).where("fold <> 0").select("item")).withColumn("w", F.round("w", 6))


def mnb_sql(cut: int | None = None) -> str:
    return f"""WITH {counts_sql(cut)}, k AS (SELECT DISTINCT fold FROM f),
size AS (SELECT k.fold, count(*)::DOUBLE AS n FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold),
df AS (SELECT k.fold, tf.term, count(*) AS df FROM k JOIN f ON f.fold <> k.fold JOIN tf ON tf.item = f.item GROUP BY k.fold, tf.term),
voc AS (SELECT fold, count(*) AS v FROM df GROUP BY fold),
w0 AS (SELECT df.fold, tf.item, tf.term, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term JOIN size ON size.fold = df.fold),
nrm AS (SELECT fold, item, sqrt(sum(w * w)) AS s FROM w0 GROUP BY fold, item),
w AS (SELECT w0.fold, w0.item, w0.term, w / s AS w FROM w0 JOIN nrm ON nrm.fold = w0.fold AND nrm.item = w0.item),
train AS (SELECT w.fold, f.label AS y, w.term, sum(w.w) AS c FROM w JOIN f ON f.item = w.item AND f.fold <> w.fold GROUP BY w.fold, f.label, w.term),
tot AS (SELECT fold, y, sum(c) AS total FROM train GROUP BY fold, y),
pri AS (SELECT k.fold, f.label AS y, count(*) AS n FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold, f.label), al AS (SELECT fold, sum(n) AS n_all FROM pri GROUP BY fold),
known AS (SELECT f.item, f.fold, w.term, w.w FROM f JOIN w ON w.item = f.item AND w.fold = f.fold),
len AS (SELECT item, sum(w) AS len FROM known GROUP BY item),
hit AS (SELECT kn.item, t.y, sum(kn.w * ln(t.c + 1.0::DOUBLE)) AS s FROM known kn JOIN train t ON t.fold = kn.fold AND t.term = kn.term GROUP BY kn.item, t.y),
sc AS (SELECT f.item, f.fold, f.label, pri.y, round(ln(pri.n::DOUBLE / al.n_all) + coalesce(hit.s, 0) - coalesce(len.len, 0) * ln(coalesce(tot.total, 0)::DOUBLE + coalesce(voc.v, 0)), 9) AS score
FROM f JOIN pri ON pri.fold = f.fold JOIN al ON al.fold = f.fold LEFT JOIN voc ON voc.fold = f.fold LEFT JOIN tot ON tot.fold = f.fold AND tot.y = pri.y LEFT JOIN len ON len.item = f.item LEFT JOIN hit ON hit.item = f.item AND hit.y = pri.y)
SELECT item, fold::INT AS fold, label, y AS pred FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, y) AS k FROM sc) WHERE k = 1"""


def mnb(spark, sf_dir, cut=None):
    return ml.naive_bayes(counts(spark, sf_dir, cut), folds(spark, sf_dir), K)


@query(mnb_sql())
def q_mnb(spark, sf_dir):
    return mnb(spark, sf_dir)


def f1_sql(cut: int | None = None) -> str:
    return f"""SELECT fold, avg(2.0::DOUBLE * tp / (nt + np)) AS f1 FROM (SELECT fold, y, count(*) FILTER (WHERE label = y AND pred = y) AS tp, count(*) FILTER (WHERE label = y) AS nt, count(*) FILTER (WHERE pred = y) AS np
FROM (SELECT fold, label, pred, unnest(list_distinct([label, pred])) AS y FROM ({mnb_sql(cut)})) GROUP BY fold, y) GROUP BY fold"""


@query(f"SELECT fold, round(f1, 6) AS f1 FROM ({f1_sql()})")
def q_macro_f1(spark, sf_dir):
    return ml.macro_f1(mnb(spark, sf_dir), ["fold"]).withColumn("f1", F.round("f1", 6))


def both_sides(spark, sf_dir):
    a = ml.macro_f1(mnb(spark, sf_dir), ["fold"]).withColumnRenamed("f1", "raw")
    return a.join(ml.macro_f1(mnb(spark, sf_dir, 4), ["fold"]).withColumnRenamed("f1", "norm"), "fold")


SIDES = f"(SELECT a.fold, a.f1 AS raw, b.f1 AS norm FROM ({f1_sql()}) a JOIN ({f1_sql(4)}) b ON a.fold = b.fold)"


@query(f"SELECT count(*)::BIGINT AS n_folds, round(avg(raw), 6) AS f1_raw, round(avg(norm), 6) AS f1_norm, round(avg(norm - raw), 6) AS delta FROM {SIDES}")
def q_dsp(spark, sf_dir):
    """Downstream change: the mean macro-F1 with tokens cut to four letters less the one with raw tokens."""
    s = st.paired(both_sides(spark, sf_dir), [], "raw", "norm")
    return s.select(F.col("n").alias("n_folds"), F.round("mean_a", 6).alias("f1_raw"), F.round("mean_b", 6).alias("f1_norm"), F.round("delta", 6).alias("delta"))


def dsp_of(spark, sf_dir, classifier: str):
    """clf, n_folds, f1_raw, f1_norm, delta, p of a classifier over TF-IDF of both sides, each fitted on its own training side."""
    sides = [ml.macro_f1(ml.text_predict(counts(spark, sf_dir, cut), folds(spark, sf_dir), K, classifier), ["fold"]).withColumnRenamed("f1", name) for cut, name in ((None, "raw"), (4, "norm"))]
    both = materialize(sides[0].join(sides[1], "fold").select(F.lit(classifier).alias("clf"), "raw", "norm", F.round(F.col("norm") - F.col("raw"), 9).alias("d")))
    s = st.paired(both, ["clf"], "raw", "norm").join(st.wilcoxon(both.select("clf", "d"), ["clf"], "d"), "clf")
    return s.select("clf", F.col("n").alias("n_folds"), *[F.round(c, 6).alias(n) for c, n in (("mean_a", "f1_raw"), ("mean_b", "f1_norm"), ("delta", "delta"), ("p", "p"))])


@query()
def q_dsp_lr(spark, sf_dir):
    """The downstream change for logistic regression over all terms."""
    return dsp_of(spark, sf_dir, "lr")


@query()
def q_dsp_svc(spark, sf_dir):
    """The downstream change for a support vector machine over all terms."""
    return dsp_of(spark, sf_dir, "svc")


@query()
def q_svc(spark, sf_dir):
    """Labels of all vectors, each fold predicted by a Gaussian support vector machine of the others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    d = ml.stratified_folds(e.select("item", "label"), "item", "label", K).join(e.drop("label"), "item")
    return ml.fit_predict(d, K, "svc")


@query()
def q_dsp_rf(spark, sf_dir):
    """The downstream change for a random forest of 100 trees over the 4096 commonest terms."""
    return dsp_of(spark, sf_dir, "rf")


@query(f"""WITH d AS (SELECT fold, round(norm - raw, 9) AS d FROM {SIDES}), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, row_number() OVER (ORDER BY fold) - 1 AS i FROM d WHERE d <> 0),
w AS (SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS w, count(*) AS n FROM r),
s AS (SELECT b, coalesce(sum(r) FILTER (WHERE (b >> i) & 1 = 1), 0) AS t FROM (SELECT unnest(range(0, (1 << n)::BIGINT)) AS b FROM w) LEFT JOIN r ON true GROUP BY b)
SELECT 'cut' AS unit, any_value(w) AS w, least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (WHERE t <= w) / count(*)) AS p FROM s, w""")
def q_wilcoxon(spark, sf_dir):
    """The signed-rank test of the folds' changes; exact, as the SQL is, which tries all signs."""
    d = both_sides(spark, sf_dir).select(F.lit("cut").alias("unit"), F.round(F.col("norm") - F.col("raw"), 9).alias("d"))
    return st.wilcoxon(d, ["unit"], "d")


WILCOXON = f"""(WITH d AS (SELECT fold, round(norm - raw, 9) AS d FROM {SIDES}), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, row_number() OVER (ORDER BY fold) - 1 AS i FROM d WHERE d <> 0),
w AS (SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS w, count(*) AS n FROM r),
s AS (SELECT b, coalesce(sum(r) FILTER (WHERE (b >> i) & 1 = 1), 0) AS t FROM (SELECT unnest(range(0, (1 << n)::BIGINT)) AS b FROM w) LEFT JOIN r ON true GROUP BY b)
SELECT least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (WHERE t <= w) / count(*)) AS p FROM s, w)"""


@query(f"SELECT 'mnb' AS clf, round(d.delta, 6) AS package_delta, round(w.p, 6) AS package_p, round(d.delta, 6) AS replica_delta, round(w.p, 6) AS replica_p, true AS agree FROM (SELECT avg(norm - raw) AS delta FROM {SIDES}) d, {WILCOXON} w")
def q_replica_check(spark, sf_dir):
    """What NormalizationStudy says of the downstream change, from whole texts, against a replica that is put together from counted terms."""
    from tessellex.plans import NormalizationStudy

    t = text.tokenize(F.lower(F.coalesce("text", F.lit(""))))
    cut = F.array_join(F.transform(t, lambda x: F.left(x, F.lit(4))), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(t, " ").alias("raw"), cut.alias("norm"))
    package = NormalizationStudy(d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")).downstream(k=K)
    sides = materialize(both_sides(spark, sf_dir).select(F.lit("mnb").alias("clf"), "raw", "norm", F.round(F.col("norm") - F.col("raw"), 9).alias("d")))
    replica = st.paired(sides, ["clf"], "raw", "norm").select("clf", F.col("delta").alias("replica_delta")).join(st.wilcoxon(sides.select("clf", "d"), ["clf"], "d").select("clf", F.col("p").alias("replica_p")), "clf")
    both = package.select(F.lit("mnb").alias("clf"), F.col("delta").alias("package_delta"), F.col("p").alias("package_p")).join(replica, "clf")
    same = (F.abs(F.col("package_delta") - F.col("replica_delta")) < 1e-9) & (F.abs(F.col("package_p") - F.col("replica_p")) < 1e-9)
    return both.select("clf", *[F.round(c, 6).alias(c) for c in ("package_delta", "package_p", "replica_delta", "replica_p")], same.alias("agree"))


@query(f"SELECT a.item, a.fold, a.label, a.pred AS pred_raw, b.pred AS pred_norm FROM ({mnb_sql()}) a JOIN ({mnb_sql(4)}) b ON a.item = b.item")
def q_oof(spark, sf_dir):
    a = mnb(spark, sf_dir).withColumnRenamed("pred", "pred_raw")
    return a.join(mnb(spark, sf_dir, 4).select("item", F.col("pred").alias("pred_norm")), "item")


OOF = f"(SELECT a.label = a.pred AS ok_a, b.label = b.pred AS ok_b FROM ({mnb_sql()}) a JOIN ({mnb_sql(4)}) b ON a.item = b.item)"


@query(f"""SELECT a_only, b_only, "both", neither, a_only + b_only < 25 AS exact, CASE WHEN a_only + b_only < 25 THEN least(a_only, b_only)::DOUBLE ELSE round((abs(a_only - b_only) - 1)::DOUBLE ^ 2 / (a_only + b_only), 6) END AS statistic
FROM (SELECT (count(*) FILTER (WHERE ok_a AND NOT ok_b))::BIGINT AS a_only, (count(*) FILTER (WHERE ok_b AND NOT ok_a))::BIGINT AS b_only, (count(*) FILTER (WHERE ok_a AND ok_b))::BIGINT AS "both", (count(*) FILTER (WHERE NOT ok_a AND NOT ok_b))::BIGINT AS neither FROM {OOF})""")
def q_mcnemar(spark, sf_dir):
    o = q_oof(spark, sf_dir).select((F.col("label") == F.col("pred_raw")).alias("a"), (F.col("label") == F.col("pred_norm")).alias("b"))
    return st.mcnemar(o, [], "a", "b").drop("p").withColumn("statistic", F.round("statistic", 6))


@query()
def q_mcnemar_p(spark, sf_dir):
    o = q_oof(spark, sf_dir).select((F.col("label") == F.col("pred_raw")).alias("a"), (F.col("label") == F.col("pred_norm")).alias("b"))
    return st.mcnemar(o, [], "a", "b").select("statistic", "p", "exact")


@query("SELECT unit, seed, clf FROM (SELECT DISTINCT lang AS unit FROM documents), (VALUES (42), (7), (2024)) s(seed), (VALUES ('mnb'), ('lr'), ('svc'), ('rf')) c(clf)")
def q_grid(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select(F.col("lang").alias("unit")).distinct()
    u = u.withColumn("seed", F.explode(F.array(*map(F.lit, (42, 7, 2024)))))
    return u.withColumn("clf", F.explode(F.array(*map(F.lit, ("mnb", "lr", "svc", "rf")))))


@query(f"""SELECT lang, count(*)::BIGINT AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(b - a), 4) AS delta, round(stddev_samp(b - a), 4) AS sd, round(avg(b - a) / stddev_samp(b - a), 4) AS d_z
FROM (SELECT lang, len({TOKENS})::DOUBLE AS a, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+'))::DOUBLE AS b FROM documents) GROUP BY lang""")
def q_paired_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.size(text.tokenize(F.col("text"))).cast("double").alias("a"), F.size(text.words(F.col("text"))).cast("double").alias("b"))
    return st.paired(d, ["lang"], "a", "b").select("lang", "n", *[F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "delta", "sd", "d_z")])


VALUES = "SELECT label, vec_id AS item, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS v FROM embeddings"


@query(f"SELECT label, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({resampling.bootstrap_sql(VALUES, 'label')})")
def q_bootstrap(spark, sf_dir):
    """The interval of each label's mean from 10,000 replicates."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 6).alias("v"))
    return resampling.bootstrap(e, ["label"], "v", "vec_id").select("label", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").cast("double").alias("x"), F.round(F.avg("value"), 6).alias("y"), F.round(F.max("value"), 6).alias("z"))


USERS = "SELECT user_id, count(*)::DOUBLE AS x, round(avg(value), 6) AS y, round(max(value), 6) AS z FROM events GROUP BY user_id"
RHO = """SELECT count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS rx,
rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0::DOUBLE AS ry FROM ({t}))"""


@query(RHO.format(x="x", y="y", t=USERS))
def q_spearman(spark, sf_dir):
    d = by_user(spark, sf_dir).withColumn("g", F.lit(0))
    return st.spearman(d, ["g"], "x", "y").select("n", F.round("rho", 6).alias("rho"))


@query()
def q_spearman_p(spark, sf_dir):
    d = by_user(spark, sf_dir).withColumn("g", F.lit(0))
    return st.spearman(d, ["g"], "x", "y").select("n", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"))


@query(f"SELECT 'y' AS target, n, rho FROM ({RHO.format(x='x', y='y', t=USERS)}) UNION ALL SELECT 'z', n, rho FROM ({RHO.format(x='x', y='z', t=USERS)})")
def q_pooled_spearman(spark, sf_dir):
    d = by_user(spark, sf_dir).unpivot(["user_id", "x"], ["y", "z"], "target", "v")
    return st.spearman(d, ["target"], "x", "v").select("target", "n", F.round("rho", 6).alias("rho"))


@query(f"""WITH p AS (SELECT toxic AS g, doc_id, (('0x' || substr(md5('p:' || doc_id), 1, 6))::BIGINT / 16777216.0::DOUBLE) ^ 4 AS p FROM labels),
s AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, doc_id) + 1)) AS s FROM p)
SELECT g, doc_id, round(max(s) OVER (PARTITION BY g ORDER BY p, doc_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")
def q_holm(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    d = table(spark, sf_dir, "labels").select(F.col("toxic").alias("g"), "doc_id", F.pow(u, F.lit(4)).alias("p"))
    return st.holm(d, ["g"], "p").select("g", "doc_id", F.round("p_holm", 6).alias("p_holm"))


@query("SELECT event_type, min(value) AS least, max(value) AS most, round(median(value), 6) AS mid, (count(*) FILTER (WHERE value > 50))::BIGINT AS above FROM events GROUP BY event_type")
def q_aggregates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("mid"), F.count_if(F.col("value") > 50).alias("above"))


@query(f"""SELECT lang, sum(n)::BIGINT AS tokens, round(avg(same), 6) AS accuracy, round(avg(same_inflected), 6) AS inflected FROM (
SELECT lang, len(t) AS n, len(list_filter(t, lambda x: left(lower(x), 6) = lower(x)))::DOUBLE / greatest(1, len(t)) AS same,
len(list_filter(t, lambda x: x <> lower(x) AND left(lower(x), 6) = lower(x)))::DOUBLE / greatest(1, len(list_filter(t, lambda x: x <> lower(x)))) AS same_inflected FROM (SELECT lang, {TOKENS} AS t FROM documents)) GROUP BY lang""")
def q_lemma_accuracy(spark, sf_dir):
    """Made lemmas (six letters) against gold ones (lower case), over all tokens and over those that the gold changes."""
    d = table(spark, sf_dir, "documents").select("lang", text.tokenize(F.col("text")).alias("t"))
    hit = lambda x: F.left(F.lower(x), F.lit(6)) == F.lower(x)
    moved = F.filter("t", lambda x: x != F.lower(x))
    same, inflected = F.size(F.filter("t", hit)) / F.greatest(F.lit(1), F.size("t")), F.size(F.filter(moved, hit)) / F.greatest(F.lit(1), F.size(moved))
    return d.groupBy("lang").agg(F.sum(F.size("t")).alias("tokens"), F.round(F.avg(same), 6).alias("accuracy"), F.round(F.avg(inflected), 6).alias("inflected"))


@query(f"SELECT doc_id, CASE WHEN {VALID} THEN 'made' ELSE 'input' END AS used, md5(CASE WHEN {VALID} THEN m ELSE text END) AS digest FROM (SELECT doc_id, text, {SHORT_OUT} AS m FROM documents)")
def q_fallback(spark, sf_dir):
    """What a normaliser made where it is valid, else the input: distinct inputs only are made once, in batches of like length, and joined back."""
    load = lambda: lambda texts: [" ".join(t for t in x.split() if len(t) > 2) for x in texts]
    d = inference.normalise(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", load)
    return d.select("doc_id", F.when(F.col("used") == "input", "input").otherwise("made").alias("used"), F.md5("norm").alias("digest"))


@query()
def q_mpd(spark, sf_dir):
    """Zero-shot change: MLlib's logistic regression fitted on label parity of raw vectors, applied to raw and sign vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    raw = e.select("vec_id", "y", array_to_vector("e").alias("features"))
    model = LogisticRegression(labelCol="y", maxIter=50, regParam=0.01).fit(raw.where("vec_id % 2 = 0"))
    held = e.where("vec_id % 2 = 1")
    other = held.select("vec_id", "y", array_to_vector(F.transform("e", F.signum)).alias("features"))
    rows = [model.transform(d).select(F.lit(n).alias("side"), F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")) for n, d in (("raw", raw.where("vec_id % 2 = 1")), ("sign", other))]
    return ml.macro_f1(rows[0].unionByName(rows[1]), ["side"])
