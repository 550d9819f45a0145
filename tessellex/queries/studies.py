"""Composites of the metrics by language, comparisons with intervals, classifiers over features, and smaller reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellex.functions import text
from tessellex.operators import alignment, generation, inference, ranking, resampling
from tessellex.operators import learning as ml
from tessellex.operators import retrieval as ir
from tessellex.operators import statistics as st
from tessellex.operators import vocabulary as vo
from tessellex.plans.tables import flatten_json
from tessellex.sources import TextSets, aligned_sheets, table
from tessellex.sources.scratch import materialize

from . import learning as ql
from . import query, texts
from . import retrieval as qr
from .scores import COS, E, pairs
from .texts import TOKENS

# --- tiers ----------------------------------------------------------------------------------------

TIER_A = f"""WITH v AS ({texts.vocabulary_sql('lang, source')}), w AS ({texts.vocabulary_sql('lang')}), s AS (SELECT lang, v_raw::DOUBLE / v_ortho AS cr FROM v)
SELECT w.lang, w.v_raw, w.v_ortho, round(w.v_raw::DOUBLE / w.v_ortho, 6) AS cr_ortho, x.n, x.mean, x.least, x.most, x.spread
FROM w JOIN (SELECT lang, count(*)::BIGINT AS n, round(avg(cr), 5) AS mean, round(min(cr), 6) AS least, round(max(cr), 6) AS most, round(max(cr) - min(cr), 5) AS spread FROM s GROUP BY lang) x ON x.lang = w.lang"""


@query(TIER_A)
def q_tier_a(spark, sf_dir):
    """What orthography alone does to each language, and how its variants (here sources) differ."""
    v = vo.vocabulary(texts.conditions(spark, sf_dir, ["lang"]), ["lang"], texts.ALL)
    by_variant = vo.vocabulary(texts.conditions(spark, sf_dir, ["lang", "source"]), ["lang", "source"], texts.ALL).select("lang", (F.col("v_raw") / F.col("v_ortho")).alias("cr"))
    x = by_variant.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("cr"), 5).alias("mean"), F.round(F.min("cr"), 6).alias("least"), F.round(F.max("cr"), 6).alias("most"), F.round(F.max("cr") - F.min("cr"), 5).alias("spread"),
    )
    return v.select("lang", "v_raw", "v_ortho", F.round(F.col("v_raw") / F.col("v_ortho"), 6).alias("cr_ortho")).join(x, "lang")


def stemmed(spark, sf_dir):
    """doc_id, lang, raw (orthographic tokens), norm (their stems)."""
    from tessellex.functions import stemmers

    p = texts.pairs(spark, sf_dir)
    return p.select("doc_id", "lang", F.col("norm").alias("raw"), stemmers.stem_arrays(F.col("norm"), F.col("lang")).alias("norm"))


def anld_ci(pairs_, n_boot=10_000):
    """lang, anld, lo, hi, n_types: the distances of words and their bootstrap interval."""
    words = alignment.word_distances(alignment.align(pairs_, padded=False, keys=("lang",), first_only=True), ["lang"])
    ci = resampling.bootstrap(words, ["lang"], "distance", "src", n_boot)
    return ci.select("lang", F.col("mean").alias("anld"), "lo", "hi", F.col("n").alias("n_types"))


@query()
def q_anld_ci(spark, sf_dir):
    """The truncated form's mean over words, with the interval that its per-word values give."""
    a = anld_ci(texts.pairs(spark, sf_dir))
    return a.select("lang", "n_types", *[F.round(c, 6).alias(c) for c in ("anld", "lo", "hi")])


@query()
def q_tier_b(spark, sf_dir):
    """Stems against orthography by language: sizes and ratios, distance with its interval, divergence, gain and score.

    Retention is the mean cosine of the vectors of the language's documents (those of their ids) and of their signs.
    """
    sizes = texts.q_cr_stems(spark, sf_dir)
    kl = vo.kl_divergence(texts.conditions(spark, sf_dir, ["lang"], stems=True).where("condition <> 'raw'"), ["lang"], "ortho", "full", weight=F.col("n"))
    of = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    irs = pairs(spark, sf_dir).join(of, "vec_id").groupBy("lang").agg(F.avg(vo.cosine(F.col("e"), F.col("s"))).alias("irs"))
    a = anld_ci(stemmed(spark, sf_dir))
    out = sizes.join(a, "lang").join(kl, "lang").join(irs, "lang", "left")
    gain = vo.vrg(F.col("cr_morph"))
    return out.withColumns({"vrg": F.round(gain, 6), "aes": F.round(vo.aes(F.col("irs"), gain), 6)}).select(
        "lang", *texts.ALL_SIZES, "cr_total", "cr_ortho", "cr_morph", "morph_share", "n_types", *[F.round(c, 6).alias(c) for c in ("anld", "lo", "hi", "kl", "irs")], "vrg", "aes",
    )


def third(spark, sf_dir):
    """Correct top-1 answers of raw, coarse (values in quarters) and sign vectors: three stages of a normaliser."""
    e = table(spark, sf_dir, "embeddings")
    kinds = {"raw": lambda x: x.cast("double"), "ortho": lambda x: F.floor(x.cast("double") * 4 + 0.5) / 4, "full": lambda x: F.signum(x.cast("double"))}
    out = None
    for name, f in kinds.items():
        q = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("qid"), F.transform("embedding", f).alias("vector"))
        pool = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("did"), F.transform("embedding", f).alias("vector"))
        top = ir.dense_top1(q, pool).join(e.select(F.col("vec_id").alias("did"), F.col("label").alias("found")), "did").join(e.select(F.col("vec_id").alias("qid"), "label"), "qid")
        top = top.select("qid", "label", (F.col("label") == F.col("found")).alias(name))
        out = top if out is None else out.join(top.drop("label"), "qid")
    return out


THIRD = f"""SELECT a.vec_id AS qid, a.label, {', '.join(f"(SELECT arg_max(b.label, (round(list_dot_product(a.{k}, b.{k}) / (sqrt(list_dot_product(a.{k}, a.{k})) * sqrt(list_dot_product(b.{k}, b.{k}))), 9), -b.vec_id)) FROM v b WHERE b.vec_id % 5 = 0) = a.label AS {n}" for k, n in (('r', 'raw'), ('o', '"ortho"'), ('f', '"full"')))}
FROM v a WHERE a.vec_id % 5 <> 0"""
THIRD_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 4 + 0.5) / 4) AS o, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN -1.0 ELSE 0.0 END::DOUBLE) AS f FROM embeddings)"


@query(f"""WITH {THIRD_V}, t AS ({THIRD}) SELECT label, count(*)::BIGINT AS n, round(avg(raw::INT), 6) AS r1_raw, round(avg("ortho"::INT), 6) AS r1_ortho, round(avg("full"::INT), 6) AS r1_full,
round(avg("full"::INT) - avg(raw::INT), 6) AS delta, round(avg("full"::INT) - avg("ortho"::INT), 6) AS delta_morph FROM t GROUP BY label""")
def q_dense_pivot(spark, sf_dir):
    """Queries against the pool of a pivot (here every fifth vector, which queries are not): recall of three stages and its changes."""
    avg = lambda c: F.avg(F.col(c).cast("double"))
    return third(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), *[F.round(avg(c), 6).alias(f"r1_{c}") for c in ("raw", "ortho", "full")], F.round(avg("full") - avg("raw"), 6).alias("delta"), F.round(avg("full") - avg("ortho"), 6).alias("delta_morph"),
    )


@query(f"""WITH {THIRD_V}, t AS ({THIRD}), g AS (SELECT label, count(*)::BIGINT AS n, avg(raw::INT) AS r, avg("full"::INT) - avg(raw::INT) AS d, (count(*) FILTER (WHERE raw AND NOT "full"))::BIGINT AS a_only, (count(*) FILTER (WHERE NOT raw AND "full"))::BIGINT AS b_only FROM t GROUP BY label)
SELECT label, n, round(r, 6) AS r1_raw, round(d, 6) AS delta, a_only, b_only, CASE WHEN a_only + b_only < 25 THEN least(a_only, b_only)::DOUBLE ELSE round((abs(a_only - b_only) - 1)::DOUBLE ^ 2 / (a_only + b_only), 6) END AS statistic, r >= 0.1 AS competent FROM g""")
def q_tier_c(spark, sf_dir):
    """Retrieval by language (here label): recall, its change, McNemar's counts, and whether the raw recall passes the floor of 0.1."""
    t = third(spark, sf_dir)
    test = st.mcnemar(t, ["label"], "raw", "full").select("label", "a_only", "b_only", F.round("statistic", 6).alias("statistic"))
    avg = lambda c: F.avg(F.col(c).cast("double"))
    return t.groupBy("label").agg(F.count("*").alias("n"), F.round(avg("raw"), 6).alias("r1_raw"), F.round(avg("full") - avg("raw"), 6).alias("delta"), (avg("raw") >= 0.1).alias("competent")).join(test, "label")


TIER_D = f"""WITH t AS (SELECT lang, 'light' AS method, lower(token) AS a, token AS r FROM (SELECT lang, unnest({TOKENS}) AS token FROM documents) UNION ALL SELECT lang, 'heavy', left(lower(token), 4), token FROM (SELECT lang, unnest({TOKENS}) AS token FROM documents)),
m AS (SELECT lang, method, count(DISTINCT r)::DOUBLE / count(DISTINCT a) AS cr FROM t GROUP BY lang, method)
SELECT l.lang, round(l.cr, 6) AS cr_light, round(h.cr, 6) AS cr_heavy, h.cr > l.cr AS heavy_compresses_more FROM m l JOIN m h ON l.lang = h.lang WHERE l.method = 'light' AND h.method = 'heavy'"""


@query(TIER_D)
def q_tier_d(spark, sf_dir):
    """Two normalisers of one language (a light and a heavy one) and the order in which they compress."""
    d = table(spark, sf_dir, "documents")
    t = vo.types(d, ["lang"], text.tokenize(F.col("text"))).withColumns({"light": F.lower("token"), "heavy": F.left(F.lower("token"), F.lit(4))})
    v = vo.vocabulary(vo.exploded(t, ["lang"], raw=F.array("token"), light=F.array("light"), heavy=F.array("heavy")), ["lang"], ["raw", "light", "heavy"])
    light, heavy = F.col("v_raw") / F.col("v_light"), F.col("v_raw") / F.col("v_heavy")
    return v.select("lang", F.round(light, 6).alias("cr_light"), F.round(heavy, 6).alias("cr_heavy"), (heavy > light).alias("heavy_compresses_more"))


# --- comparisons ----------------------------------------------------------------------------------


@query()
def q_ir_compare_ci(spark, sf_dir):
    """Two conditions of retrieval by query: the change of the reciprocal rank with its interval, and McNemar's test of rank one."""
    j = qr.ranks(spark, sf_dir, "tok").join(qr.ranks(spark, sf_dir, "cut").withColumnRenamed("rank", "other"), "qid")
    return st.comparison(j, [], "rank", "other", "qid").select(*[F.round(c, 9).alias(c) for c in ("delta", "lo", "hi", "statistic", "p")], "a_only", "b_only", "exact")


@query()
def q_paired_ci(spark, sf_dir):
    """The change of the token count of each language's documents with its 95 % t-interval."""
    d = table(spark, sf_dir, "documents").select("lang", F.size(text.tokenize(F.col("text"))).cast("double").alias("a"), F.size(text.words(F.col("text"))).cast("double").alias("b"))
    return st.paired(d, ["lang"], "a", "b").select("lang", "n", *[F.round(c, 6).alias(c) for c in ("delta", "sd", "lo", "hi")])


BETTER = resampling.bootstrap_sql("SELECT label, vec_id AS item, (list_sum(embedding[1:len(embedding) // 2]::DOUBLE[]) - list_sum(embedding[len(embedding) // 2 + 1:]::DOUBLE[])) AS v FROM embeddings", "label")


@query(f"SELECT CASE WHEN lo > 0 THEN 'better' WHEN hi < 0 THEN 'worse' ELSE 'same' END AS verdict, count(*)::BIGINT AS n FROM ({BETTER}) GROUP BY ALL")
def q_interval_verdict(spark, sf_dir):
    """Better, worse or same by the sign of each group's interval (10,000 replicates) of a paired difference: the halves of a vector."""
    half = (F.size("embedding") / 2).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    v = total(F.slice("embedding", F.lit(1), half)) - total(F.slice("embedding", half + 1, F.size("embedding")))
    ci = resampling.bootstrap(table(spark, sf_dir, "embeddings").select("label", "vec_id", v.alias("v")), ["label"], "v", "vec_id")
    return ci.groupBy(F.when(F.col("lo") > 0, "better").when(F.col("hi") < 0, "worse").otherwise("same").alias("verdict")).agg(F.count("*").alias("n"))


P_VALUE = "(('0x' || substr(md5('p:' || doc_id), 1, 6))::BIGINT / 16777216.0::DOUBLE) ^ 4"


def p_values(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("g"), F.round(F.pow(u, F.lit(4)), 4).alias("p"))


@query(f"SELECT g, (count(*) FILTER (WHERE p <= 0.05))::BIGINT AS at_most, (count(*) FILTER (WHERE p < 0.05))::BIGINT AS below FROM (SELECT toxic AS g, round({P_VALUE}, 4) AS p FROM labels) GROUP BY g")
def q_significance(spark, sf_dir):
    """Significant results, by both comparators that reports use."""
    return p_values(spark, sf_dir).groupBy("g").agg(F.count_if(F.col("p") <= 0.05).alias("at_most"), F.count_if(F.col("p") < 0.05).alias("below"))


@query(f"SELECT doc_id, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', round(p, 3)) END AS shown FROM (SELECT doc_id, round({P_VALUE}, 4) AS p FROM labels)")
def q_p_format(spark, sf_dir):
    return p_values(spark, sf_dir).select("doc_id", text.p_text(F.col("p")).alias("shown"))


STACK = """WITH u AS (SELECT user_id, event_type AS method, count(*)::DOUBLE AS x, round(avg(value), 6) AS y FROM events GROUP BY user_id, event_type),
b AS (SELECT method FROM u ORDER BY method LIMIT 1), d AS (SELECT a.user_id, a.method, round(a.x - c.x, 6) AS x, round(a.y - c.y, 6) AS y FROM u a JOIN u c ON a.user_id = c.user_id AND c.method = (SELECT method FROM b) WHERE a.method <> c.method)"""


@query(f"{STACK} SELECT 'pooled' AS kind, n, rho FROM ({ql.RHO.format(x='x', y='y', t='SELECT * FROM u')}) UNION ALL SELECT 'change', n, rho FROM ({ql.RHO.format(x='x', y='y', t='SELECT * FROM d')})")
def q_pooled_change(spark, sf_dir):
    """Rank correlation over stacked methods (here event types) and over their changes against the first method, unit by unit."""
    u = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("method")).agg(F.count("*").cast("double").alias("x"), F.round(F.avg("value"), 6).alias("y"))
    base = u.agg(F.min("method").alias("m")).head()[0]
    first = u.where(F.col("method") == base).select("user_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    d = u.where(F.col("method") != base).join(first, "user_id").select("user_id", "method", F.round(F.col("x") - F.col("x0"), 6).alias("x"), F.round(F.col("y") - F.col("y0"), 6).alias("y"))
    both = u.withColumn("kind", F.lit("pooled")).unionByName(d.withColumn("kind", F.lit("change")))
    return st.spearman(both, ["kind"], "x", "y").select("kind", "n", F.round("rho", 6).alias("rho"))


# --- learning -------------------------------------------------------------------------------------


@query()
def q_dsp_features(spark, sf_dir):
    """Downstream change over precomputed features, for logistic regression and a random forest: raw vectors against sign vectors, three folds, label parity."""
    e = table(spark, sf_dir, "embeddings")
    items = ml.stratified_folds(e.select(F.col("vec_id").alias("item"), (F.col("label") % 2).alias("label")), "item", "label", k=3)
    out = None
    for clf in ("lr", "rf"):
        sides = []
        for side, f in (("raw", lambda x: x.cast("double")), ("norm", lambda x: F.signum(x.cast("double")))):
            d = items.join(e.select(F.col("vec_id").alias("item"), F.transform("embedding", f).alias("features")), "item")
            sides.append(ml.macro_f1(ml.fit_predict(d, 3, clf), ["fold"]).withColumnRenamed("f1", side))
        both = sides[0].join(sides[1], "fold").withColumn("clf", F.lit(clf))
        out = both if out is None else out.unionByName(both)
    p = st.wilcoxon(out.select("clf", (F.col("norm") - F.col("raw")).alias("d")), ["clf"], "d").select("clf", "p")
    s = st.paired(out, ["clf"], "raw", "norm").join(p, "clf")
    return s.select("clf", F.col("n").alias("n_folds"), *[F.round(c, 6).alias(n) for c, n in (("mean_a", "f1_raw"), ("mean_b", "f1_norm"), ("delta", "delta"), ("p", "p"))])


@query()
def q_mpd_change(spark, sf_dir):
    """Zero-shot change: a regression fitted on one half's raw vectors, applied to the other half's raw and sign vectors, by label; the change of macro-F1 and McNemar's test."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label", (F.col("vec_id") % 2).alias("half"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    y = (F.col("label") % 2).alias("label")
    train = e.where("half = 0").select("item", y, F.lit(1).alias("fold"), F.col("e").alias("features"))
    held = lambda v: e.where("half = 1").select("item", y, F.lit(0).alias("fold"), v.alias("features"))
    a, b = (ml.fit_predict(train.unionByName(held(v)), 1, "lr") for v in (F.col("e"), F.transform("e", F.signum)))
    j = a.join(b.select("item", F.col("pred").alias("other")), "item").join(e.select("item", F.col("label").alias("group")), "item")
    f1 = lambda p, name: ml.macro_f1(j.select("group", "label", F.col(p).alias("pred")), ["group"]).withColumnRenamed("f1", name)
    test = st.mcnemar(j.select("group", (F.col("label") == F.col("pred")).alias("x"), (F.col("label") == F.col("other")).alias("y")), ["group"], "x", "y")
    out = f1("pred", "f1_raw").join(f1("other", "f1_norm"), "group").join(test, "group")
    return out.select("group", F.round("f1_raw", 6).alias("f1_raw"), F.round("f1_norm", 6).alias("f1_norm"), F.round(F.col("f1_norm") - F.col("f1_raw"), 6).alias("mpd"), "a_only", "b_only", F.round("p", 9).alias("p"))


WORDS = f"list_transform({TOKENS}, lambda x: lower(x))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {WORDS} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS c, b.t AS r FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(c) + len(r) > 0 THEN round(2.0::DOUBLE * list_sum(list_transform(list_distinct(c), lambda x: least(len(list_filter(c, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) / (len(c) + len(r)), 6) ELSE 0 END AS rouge1 FROM p""")
def q_rouge1(spark, sf_dir):
    """Words that a turn and its answer share, as an F1."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.tokenize(F.lower("text")).alias("t"))
    a = t.where("role = 'user'").select("conv_id", "turn", F.col("t").alias("c"))
    b = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.rouge1(F.col("c"), F.col("r")), 6).alias("rouge1"))


def grams_sql(side: str) -> str:
    every = " UNION ALL ".join(f"SELECT fold, item, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: list_slice({side}, i, i + {n} - 1))) AS gram FROM p" for n in range(1, 5))
    return f"(SELECT fold, item, n, gram, count(*) AS c FROM ({every}) GROUP BY ALL)"


def bleu_sql(tokens: str) -> str:
    """fold, bleu of turns against their answers."""
    hits = [f"(CASE WHEN h{n} > 0 THEN h{n} ELSE 1.0::DOUBLE / (1 << ({' + '.join(f'(h{m} = 0)::INT' for m in range(1, n + 1))})) END / greatest(t{n}, 1))" for n in range(1, 5)]
    return f"""WITH t AS (SELECT conv_id, turn, role, {tokens} AS t FROM conversations),
q AS (SELECT a.conv_id * 1000 + a.turn AS item, a.t AS c, b.t AS r FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
p AS (SELECT *, ((row_number() OVER (ORDER BY md5('42:' || item), item) - 1) % 3)::INT AS fold FROM q),
g AS (SELECT x.fold, x.n, sum(x.c) AS t, sum(least(x.c, coalesce(y.c, 0))) AS h FROM {grams_sql('c')} x LEFT JOIN {grams_sql('r')} y ON y.fold = x.fold AND y.item = x.item AND y.n = x.n AND y.gram = x.gram GROUP BY x.fold, x.n),
s AS (SELECT fold, {', '.join(f'coalesce(sum(h) FILTER (WHERE n = {n}), 0)::DOUBLE AS h{n}, coalesce(sum(t) FILTER (WHERE n = {n}), 0)::DOUBLE AS t{n}' for n in range(1, 5))} FROM g GROUP BY fold),
l AS (SELECT fold, sum(len(c))::DOUBLE AS c, sum(len(r))::DOUBLE AS r FROM p GROUP BY fold)
SELECT l.fold, CASE WHEN least(t1, t2, t3, t4) = 0 THEN 0.0 ELSE 100 * CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / greatest(c, 1)) END * exp(({' + '.join(f'ln({h})' for h in hits)}) / 4) END AS bleu FROM l JOIN s ON s.fold = l.fold"""


@query(f"SELECT a.fold, round(a.bleu, 6) AS bleu_raw, round(b.bleu, 6) AS bleu_norm, round(b.bleu - a.bleu, 6) AS delta FROM ({bleu_sql(TOKENS)}) a JOIN ({bleu_sql(WORDS)}) b ON a.fold = b.fold")
def q_bleu(spark, sf_dir):
    """BLEU of turns against their answers in three folds, of tokens as they are and lower-cased."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("made"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    counts = lambda f: generation.gram_counts(*[text.tokenize(f(F.col(c))) for c in ("made", "reference")])
    p = a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), counts(lambda c: c).alias("raw"), counts(F.lower).alias("norm"))
    p = materialize(generation.folds(materialize(p), "item"))  # numbers of each text: its words are shuffled by the join alone
    sides = []
    for name in ("raw", "norm"):
        sums = generation.summed(p, ["fold"], name)
        sides.append(sums.select("fold", generation.bleu(sums).alias(name)))
    return sides[0].join(sides[1], "fold").select("fold", F.round("raw", 6).alias("bleu_raw"), F.round("norm", 6).alias("bleu_norm"), F.round(F.col("norm") - F.col("raw"), 6).alias("delta"))


DIMENSIONS = ["cr_total", "kl", "anld", "irs", "aes"]


@query()
def q_dimensions(spark, sf_dir):
    """Rank correlations, and their p, of all pairs of the five measures of stems by language: CR, KL, ANLD, IRS and AES."""
    each = materialize(q_tier_b(spark, sf_dir).select("lang", *[F.col(c).cast("double").alias(c) for c in DIMENSIONS]).unpivot("lang", DIMENSIONS, "dim", "v"))
    j = each.alias("a").join(each.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.dim") < F.col("b.dim")))
    j = j.select(F.col("a.dim").alias("dim_a"), F.col("b.dim").alias("dim_b"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    return st.spearman(j, ["dim_a", "dim_b"], "x", "y").select("dim_a", "dim_b", "n", F.round("rho", 6).alias("rho"), F.round("p", 9).alias("p"))


GOLD = "list_transform(f, lambda x: lower(x))"


@query(f"""WITH s AS (SELECT lang, doc_id, {TOKENS} AS f, list_filter({TOKENS}, lambda x: length(x) > 1) AS m FROM documents), a AS (SELECT lang, doc_id, f, {GOLD} AS g, list_transform(m, lambda x: lower(left(x, 6))) AS m FROM s),
e AS (SELECT lang, f[i] AS f, g[i] AS g, m[i] AS m FROM (SELECT lang, f, g, m, unnest(range(1, len(f) + 1)) AS i FROM a WHERE len(f) = len(m)))
SELECT lang, count(*)::BIGINT AS tokens, round(avg((m = g)::INT), 6) AS accuracy, round((count(*) FILTER (WHERE f <> g AND m = g))::DOUBLE / greatest(1, count(*) FILTER (WHERE f <> g)), 6) AS inflected FROM e GROUP BY lang""")
def q_lemma_match(spark, sf_dir):
    """Made lemmas against gold ones over documents whose token counts agree: over all tokens, and over those that the gold changes."""
    d = table(spark, sf_dir, "documents").select("lang", text.tokenize(F.col("text")).alias("f"))
    made = F.transform(F.filter("f", lambda x: F.char_length(x) > 1), lambda x: F.lower(F.left(x, F.lit(6))))
    d = d.withColumns({"g": F.transform("f", F.lower), "m": made}).where(F.size("f") == F.size("m"))
    e = d.select("lang", F.explode(F.arrays_zip("f", "g", "m")).alias("t")).select("lang", "t.*")
    moved, hit = F.col("f") != F.col("g"), F.col("m") == F.col("g")
    return e.groupBy("lang").agg(F.count("*").alias("tokens"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.round(F.count_if(moved & hit) / F.greatest(F.lit(1), F.count_if(moved)), 6).alias("inflected"))


# --- sets, sheets, batches ------------------------------------------------------------------------


@query("SELECT 'documents' AS name, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'questions', count(*), sum(length(text)) FROM conversations WHERE role = 'user' UNION ALL SELECT 'benchmark', count(*), sum(length(text)) FROM benchmark")
def q_text_sets(spark, sf_dir):
    """The corpora that a study knows by name."""
    t = lambda name: table(spark, sf_dir, name)
    sets = TextSets(
        documents=lambda: t("documents").withColumnRenamed("doc_id", "id"), benchmark=lambda: t("benchmark").withColumnRenamed("item_id", "id"),
        questions=lambda: t("conversations").where("role = 'user'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")),
    )
    out = None
    for name in sets.sets:
        one = sets(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT a.doc_id, md5(a.text) AS digest, b.quality AS label FROM documents a JOIN labels b ON a.doc_id = b.doc_id")
def q_two_sheets(spark, sf_dir):
    """Two sheets of the same rows: texts of one, labels of the other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    one = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    return aligned_sheets(one, labels, "doc_id").select("doc_id", F.md5("text").alias("digest"), "label")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def q_longest_first(spark, sf_dir):
    """Batches of 32 texts of like length, the longest first."""
    d = table(spark, sf_dir, "documents").select("doc_id", (-F.char_length(F.coalesce("text", F.lit("")))).alias("size"))
    at = ranking.positions(d, [], ranking.range_of(F.col("size"), ranking.bounds(d, "size", "doc_id"), F.col("doc_id")), ["size", "doc_id"])
    return at.select("doc_id", F.floor(F.col("pos") / 32).alias("batch"))


@query("SELECT label, round(avg(list_dot_product(v, v)), 6) AS mean_norm, count(*)::BIGINT AS n FROM (SELECT label, [length(label::VARCHAR)::DOUBLE, label::DOUBLE] AS v FROM embeddings) GROUP BY label")
def q_encode(spark, sf_dir):
    """An encoder (here of two features) applied in batches, loaded once a task."""
    load = lambda: lambda texts_: [[float(len(t)), float(t)] for t in texts_]
    e = inference.encode(table(spark, sf_dir, "embeddings").select("label", F.col("label").cast("string").alias("t")), "t", load)
    return e.groupBy("label").agg(F.round(F.avg(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("mean_norm"), F.count("*").alias("n"))


@query(f"""SELECT label, round(avg(list_dot_product(o, s) / (sqrt(list_dot_product(o, o)) * sqrt(list_dot_product(s, s)))), 6) AS irs_morph, round(avg({COS}), 6) AS irs FROM (
SELECT *, list_transform(e, lambda x: floor(x * 4 + 0.5) / 4) AS o FROM ({E})) GROUP BY label""")
def q_irs_morph(spark, sf_dir):
    """Retention of the last stage alone (coarse against sign vectors) beside that of the whole."""
    p = pairs(spark, sf_dir).withColumn("o", F.transform("e", lambda x: F.floor(x * 4 + 0.5) / 4))
    return p.groupBy("label").agg(F.round(F.avg(vo.cosine(F.col("o"), F.col("s"))), 6).alias("irs_morph"), F.round(F.avg(vo.cosine(F.col("e"), F.col("s"))), 6).alias("irs"))


@query("SELECT event_type, user_id::VARCHAR AS user, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, min((props->>'$.k')::BIGINT)::BIGINT AS least FROM events GROUP BY event_type, user_id")
def q_result_table(spark, sf_dir):
    """Nested results (a JSON object of users for each event type) and the flat table of them."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("user"), F.from_json("props", "k bigint")["k"].alias("k"))
    each = e.groupBy("event_type", "user").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"))
    nested = each.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("user", F.struct("n", F.struct("total", F.array("least").alias("span")).alias("k")))))).alias("results"))
    flat = flatten_json(nested, "results", ["user"], {"n": "$.n", "total": "$.k.total", "least": "$.k.span[0]"}, keep=("event_type",))
    return flat.select("event_type", "user", *[F.col(c).cast("long").alias(c) for c in ("n", "total", "least")])
