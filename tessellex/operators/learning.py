"""Cross-validated learning as joins and aggregates: folds, TF-IDF, multinomial naive Bayes, macro-F1."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.sources.scratch import materialize, release, written

from . import bayes, kernel, logistic, ranking


def order_hash(item: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), item.cast("string")))


def stratified_folds(df: DataFrame, item: str, label: str, k: int = 10, seed: int = 42) -> DataFrame:
    """df with fold: items of a label in a seeded order, dealt to k folds by turns. The order's first digits are its ranges."""
    d = df.withColumn("fold_order", order_hash(F.col(item), seed))
    d = ranking.positions(d, [label], F.conv(F.substring("fold_order", 1, 3), 16, 10).cast("int"), ["fold_order", item], "fold_at")
    return d.withColumn("fold", (F.col("fold_at") % k).cast("int")).drop("fold_order", "fold_at")


def vocabulary_index(terms: DataFrame) -> DataFrame:
    """terms with id: 0, 1, ... in the order of the terms' MD5, whose first digits are the ranges that are numbered by themselves."""
    d = terms.withColumn("term_order", F.md5("term"))
    return ranking.positions(d, [], F.conv(F.substring("term_order", 1, 3), 16, 10).cast("int"), ["term_order", "term"], "id").drop("term_order")


def training_sizes(items: DataFrame, k: int) -> list[int]:
    """The number of items outside each fold."""
    own = {r["fold"]: r["n"] for r in items.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    return [sum(own.values()) - own.get(f, 0) for f in range(k)]


def tfidf_rows(tf: DataFrame, items: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Sparse TF-IDF rows of all items by the training side of each of k folds, and the index of the terms.

    tf: item, term, tf (counts); items: item, label, fold. Returns rows (item, label, fold, entries, norms) and terms (term, id, idf). entries holds
    (term, id, tf, idf) of the item's terms, where idf[f] is ln((1 + n) / (1 + df)) + 1 over the items outside fold f, null where none of
    them has the term; norms[f] is the length of the row by fold f. So a weight by fold f is tf * idf[f] / norms[f], and all k fits are
    one pass: document frequencies of a training side are those of all folds less the fold's own. Both are scratch tables.
    """
    items = materialize(items.select("item", "label", "fold"))
    sizes = training_sizes(items, k)
    t = materialize(tf.select("item", "term", "tf").join(items, "item"))
    held = t.groupBy("term", "fold").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("every"), F.map_from_entries(F.collect_list(F.struct("fold", "c"))).alias("own"))
    df = lambda f: F.col("every") - F.coalesce(F.try_element_at("own", F.lit(f)), F.lit(0))
    idf = F.array(*[F.when(df(f) > 0, F.log((1 + F.lit(float(n))) / (1 + df(f))) + 1) for f, n in enumerate(sizes)])
    terms = materialize(vocabulary_index(held.select("term", idf.alias("idf"))))
    # both sides are read from tables, so a term that most items have is a skewed join that Spark splits
    rows = t.join(terms, "term").groupBy("item").agg(F.collect_list(F.struct("term", "id", "tf", "idf")).alias("entries"))
    squares = lambda f: F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.coalesce(F.pow(e["tf"] * F.get(e["idf"], F.lit(f)), F.lit(2.0)), F.lit(0.0)))
    rows = items.join(rows, "item", "left").select("item", "label", "fold", F.coalesce("entries", F.array().cast(rows.schema["entries"].dataType)).alias("entries"))
    return materialize(rows.withColumn("norms", F.array(*[F.sqrt(squares(f)) for f in range(k)]))), terms


def weight(entry: Column, norms: Column, fold: Column) -> Column:
    """The weight of an entry by a fold's training side; null for a term that this side lacks."""
    return entry["tf"] * F.get(entry["idf"], fold) / F.get(norms, fold)


def tfidf(tf: DataFrame, train: DataFrame) -> DataFrame:
    """item, term, w: tf * (ln((1 + n) / (1 + df)) + 1), rows of norm 1; n and df from train (item), terms unseen there left out."""
    n = train.count()
    df = tf.join(train, "item", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").select("item", "term", (F.col("tf") * (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "item").select("item", "term", (F.col("w") / F.col("norm")).alias("w"))


def naive_bayes(tf: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item, fold, label, pred: each fold predicted by a multinomial naive Bayes over TF-IDF of the others, add-one smoothed.

    tf: item, term, tf (term counts); items: item, label, fold. TF-IDF is fitted on each fold's training side, all
    folds at once: a term's mass for a label is an array of k sums. Terms unseen in training are left out. An item without
    terms gets the likeliest label of its training side, and ties go to the least label. Items are dealt to blocks (bayes.packed), and
    what is shuffled are a block's distinct terms instead of its items' terms. The predictions are a scratch table; those of the terms, and their
    shuffles, go as soon as they have been read, so queries of several fits hold those of one at a time.
    """
    items = materialize(items.select("item", "label", "fold"))
    with logistic.brief_shuffles(items.sparkSession):
        pred = materialize(_naive_bayes(tf, items, k, made := []))
    for d in (*made, items):
        release(d)
    return pred


def _naive_bayes(tf: DataFrame, items: DataFrame, k: int, made: list[DataFrame]) -> DataFrame:
    """naive_bayes() unread; made is given the scratch tables that it reads."""
    own = {(r["label"], r["fold"]): r["n"] for r in items.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}  # a row a label and fold
    labels = sorted({y for y, _ in own})
    sizes = [float(sum(n for (_, g), n in own.items() if g != f)) for f in range(k)]
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1 if labels else F.lit(0)
    t = materialize(tf.select("item", "term", F.col("tf").cast("double").alias("tf")).join(items.select("item", number.alias("y"), F.col("fold").cast("int").alias("fold")), "item"))
    blocks = materialize(bayes.packed(t, max(items.sparkSession.sparkContext.defaultParallelism, 1 + t.count() // bayes.ENTRIES)))
    release(t)
    held = materialize(bayes.held_counts(blocks, k))
    every = lambda c, f: F.sum(F.get(c, F.lit(f)))
    summed = held.groupBy("term").agg(F.array(*[every("own", f) for f in range(k)]).alias("own"))
    df = lambda f: F.aggregate("own", F.lit(0).cast("long"), lambda x, v: x + v) - F.get("own", F.lit(f))
    idf = F.array(*[F.when(df(f) > 0, F.log((1 + F.lit(n)) / (1 + df(f))) + 1) for f, n in enumerate(sizes)])
    terms = materialize(summed.select("term", idf.alias("idf")))
    known = materialize(held.select("block", "at", "term").join(terms, "term"))
    release(held)
    mass = bayes.masses(blocks, known, k).groupBy("term", "y").agg(F.array(*[every("mass", f) for f in range(k)]).alias("mass"))
    mass = materialize(mass)
    # of a label and of all terms there are k sums each
    totals = {r["y"]: r["total"] for r in mass.groupBy("y").agg(F.array(*[every("mass", f) for f in range(k)]).alias("total")).collect()}
    seen = terms.agg(*[F.count(F.get("idf", F.lit(f))) for f in range(k)]).first()
    release(terms)
    made += [blocks, known, mass]
    model = []
    for f in range(k):
        n = {y: sum(c for (label, g), c in own.items() if label == y and g != f) for y in labels}
        model += [(f, i, y, math.log(n[y] / sum(n.values())), math.log(max(totals.get(i, [0.0] * k)[f] + seen[f], 1e-300))) for i, y in enumerate(labels) if n[y]]
    kind = items.schema["label"].dataType.simpleString()
    model = items.sparkSession.createDataFrame(model, f"fold int, at int, y {kind}, lp double, den double").groupBy("fold").agg(F.collect_list(F.struct("at", "y", "lp", "den")).alias("model"))
    hits = bayes.scores(blocks, known.join(mass, "term"), k, len(labels), items.schema["item"].dataType.simpleString())
    scored = items.join(F.broadcast(model), "fold").join(hits, "item", "left")  # the model: labels by folds
    score = lambda m: F.round(m.getField("lp") + F.coalesce(F.get("s", m.getField("at")), F.lit(0.0)) - F.coalesce("len", F.lit(0.0)) * m.getField("den"), 9)
    best = F.array_max(F.transform("model", lambda m: F.struct(score(m).alias("score"), (-m.getField("at")).alias("tie"), m.getField("y").alias("y"))))
    return scored.select("item", "fold", "label", best.getField("y").alias("pred"))


def fold_features(rows: DataFrame, fold: int, size: int) -> DataFrame:
    """item, fold, label, features: MLlib's sparse vectors of all items, weighed by the training side of one fold.

    Spark has no function that makes sparse vectors, but reads them: the fields of one are written and read back as vectors.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    seen = F.array_sort(F.filter(F.transform("entries", lambda e: F.struct(e["id"].cast("int").alias("id"), weight(e, F.col("norms"), F.lit(fold)).alias("w"))), lambda e: e["w"].isNotNull()))
    fields = [F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform("seen", lambda e: e["id"]).alias("indices"), F.transform("seen", lambda e: e["w"]).alias("values")]
    flat = rows.withColumn("seen", seen).select("item", "fold", F.col("label").cast("double").alias("label"), F.struct(*fields).alias("features"))
    schema = T.StructType([T.StructField("features", VectorUDT()) if f.name == "features" else f for f in flat.schema])
    return flat.sparkSession.read.schema(schema).parquet(written(flat))


def text_predict(tf: DataFrame, items: DataFrame, k: int, classifier: str = "lr", most_terms: int = 4096) -> DataFrame:
    """item, fold, label, pred: each fold predicted by a classifier over TF-IDF of the others' texts: mnb, svc, or one of CLASSIFIERS.

    lr is fitted by logistic.logistic, all folds at once: MLlib scales every feature by its deviation, and isn't done with rare terms after
    hundreds of steps; svc is kernel.svc, all folds at once, too. rf reads the most_terms terms that most items have (ties by MD5), since MLlib bins every feature of a row; the
    others read all terms. The rows are made once; each fold fits on its own weights.
    """
    if classifier == "rf":
        counted = tf.groupBy("term").agg(F.count("*").alias("n"))
        tf = tf.join(counted.orderBy(F.desc("n"), F.md5("term"), "term").limit(most_terms).select("term"), "term", "left_semi")
    if classifier == "mnb":
        return naive_bayes(tf, items, k)
    if classifier == "lr":
        return logistic.logistic(tf, items, k)
    rows, terms = tfidf_rows(tf, items, k)
    size, out = max(1, terms.count()), None
    if classifier == "svc":
        w = F.flatten(F.transform("entries", lambda e: F.array(*[weight(e, F.col("norms"), F.lit(f)) for f in range(k)])))
        flat = rows.select("item", "fold", "label", F.transform("entries", lambda e: e["id"].cast("int")).alias("ids"), w.alias("w"))
        sizes = terms.agg(*[F.count(F.get("idf", F.lit(f))) for f in range(k)]).first()
        return kernel.svc(flat, k, list(sizes))
    for f in range(k):
        features = fold_features(rows, f, size)
        pred = CLASSIFIERS[classifier](features.where(F.col("fold") != f)).transform(features.where(F.col("fold") == f))
        out = pred if out is None else out.unionByName(pred)
    return out.select("item", "fold", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("pred"))


def macro_f1(pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f1: the mean over labels that occur or are predicted; undefined ones are 0."""
    each = pred.select(*keys, F.explode(F.array_distinct(F.array("label", "pred"))).alias("y"), "label", "pred")
    each = each.groupBy(*keys, "y").agg(
        F.count(F.when((F.col("label") == F.col("y")) & (F.col("pred") == F.col("y")), 1)).alias("tp"),
        F.count(F.when(F.col("label") == F.col("y"), 1)).alias("n_true"),
        F.count(F.when(F.col("pred") == F.col("y"), 1)).alias("n_pred"),
    )
    return each.groupBy(*keys).agg(F.avg(2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).alias("f1"))


def _logistic(train: DataFrame):
    """Logistic regression that minimises the sum of losses and half the squared norm, which MLlib has as a mean and a strength of 1 / n."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="label", maxIter=100, regParam=1 / max(1, train.count()), standardization=False).fit(train)


def _forest(train: DataFrame):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol="label", numTrees=100, seed=42).fit(train)


#: Classifiers by name: functions that fit rows of label and features; their models add prediction.
CLASSIFIERS = {"lr": _logistic, "rf": _forest}


def fit_predict(features: DataFrame, k: int, classifier: str = "lr") -> DataFrame:
    """item, fold, label, pred: each fold predicted by a classifier (svc, or one of CLASSIFIERS) of the others.

    features: item, fold, label (numeric), features (array<double>), made once by any encoder. One fit a fold; nothing but
    the model comes to the driver.
    """
    from pyspark.ml.functions import array_to_vector

    if classifier == "svc":
        return kernel.svc(features.select("item", "fold", "label", F.col("features").alias("x")), k)
    d = materialize(features.select("item", "fold", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")))
    out = None
    for f in range(k):
        held = CLASSIFIERS[classifier](d.where(F.col("fold") != f)).transform(d.where(F.col("fold") == f))
        out = held if out is None else out.unionByName(held)
    return out.select("item", "fold", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("pred"))
