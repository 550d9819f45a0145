"""Whole evaluations: what a user of the evaluation package calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.functions.text import tokenize, tokenize_at
from tessellex.operators import alignment, generation, inference, learning, statistics, vocabulary
from tessellex.sources.scratch import materialize


class NormalizationStudy:
    """Measures a normaliser on a corpus of (doc_id, raw, norm[, label][, raw_vec, norm_vec]).

    tokenizer: a function from a text column to an array column; or delimiter, a string to split at; else Unicode
    space. encoder: a function that returns a model of lists of texts (see inference.encode), for a corpus without
    vectors. Documents are aligned by doc_id, so there is no length to check; a null side is an error of the input and
    raises. Tokens and types are made once, in scratch tables that all metrics read; scratch() around the study removes them.
    """

    def __init__(self, corpus: DataFrame, tokenizer: Callable[[Column], Column] | None = None, delimiter: str | None = None, encoder: Callable | None = None) -> None:
        cut = tokenizer or ((lambda c: tokenize_at(c, delimiter)) if delimiter else tokenize)
        if corpus.where("raw is null or norm is null").limit(1).count():
            raise ValueError("every document needs an original and a normalised text")
        if encoder and "raw_vec" not in corpus.columns:
            corpus = materialize(inference.encode(inference.encode(corpus, "raw", encoder, out="raw_vec"), "norm", encoder, out="norm_vec"))
        self.corpus = corpus
        self.pairs = materialize(corpus.select("doc_id", cut(F.col("raw")).alias("raw"), cut(F.col("norm")).alias("norm")))
        sides = [vocabulary.types(self.pairs, [], F.col(c)).withColumn("condition", F.lit(c)) for c in ("raw", "norm")]
        self.types = materialize(sides[0].unionByName(sides[1]))

    def cr(self) -> DataFrame:
        v = vocabulary.vocabulary(self.types, [], ["raw", "norm"])
        return v.select(vocabulary.ratio(F.col("v_raw"), F.col("v_norm")).alias("cr"))

    def irs(self) -> DataFrame:
        """The mean paired cosine of the vectors; 1 without vectors."""
        if "raw_vec" not in self.corpus.columns:
            return self.corpus.limit(1).select(F.lit(1.0).alias("irs"))
        return self.corpus.agg(F.avg(vocabulary.cosine(F.col("raw_vec"), F.col("norm_vec"))).alias("irs"))

    def anld(self, padded: bool = True) -> DataFrame:
        return alignment.anld(alignment.align(self.pairs, padded, first_only=True), []).select(F.coalesce("anld", F.lit(0.0)).alias("anld"))

    def kl(self, epsilon: float = 1e-12) -> DataFrame:
        return vocabulary.kl_divergence(self.types, [], "raw", "norm", epsilon, weight=F.col("n"))

    def downstream(self, k: int = 5, seed: int = 42, classifier: str = "mnb", vectorizer: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
        """f1_raw, f1_norm, delta, lo, hi, p over the same stratified folds of both sides; needs label.

        classifier: mnb, svc, or one of learning.CLASSIFIERS. vectorizer: a function of (item, text) and the side's name that returns item and features
        (array<double>), fitted on nothing. Without it the vectors of the corpus are the features, where it has any and the
        classifier isn't mnb; else TF-IDF of the tokens, fitted on each fold's training side.
        """
        items = materialize(learning.stratified_folds(self.corpus.select(F.col("doc_id").alias("item"), "label"), "item", "label", k, seed))
        side = {}
        for c in ("raw", "norm"):
            if vectorizer:
                features = vectorizer(self.corpus.select(F.col("doc_id").alias("item"), F.col(c).alias("text")), c)
            elif classifier != "mnb" and "raw_vec" in self.corpus.columns:
                features = self.corpus.select(F.col("doc_id").alias("item"), F.transform(f"{c}_vec", lambda x: x.cast("double")).alias("features"))
            else:
                features = None
            if features is not None:
                pred = learning.fit_predict(items.join(features, "item"), k, classifier)
            else:
                tf = self.pairs.select(F.col("doc_id").alias("item"), F.explode(c).alias("term")).groupBy("item", "term").agg(F.count("*").alias("tf"))
                pred = learning.text_predict(tf, items, k, classifier)
            side[c] = learning.macro_f1(pred, ["fold"]).withColumnRenamed("f1", c)
        both = materialize(side["raw"].join(side["norm"], "fold").withColumn("g", F.lit(0)).withColumn("d", F.col("norm") - F.col("raw")))
        paired = statistics.paired(both, ["g"], "raw", "norm")
        p = statistics.wilcoxon(both.select("g", "d"), ["g"], "d")
        return paired.join(p, "g").select(F.col("mean_a").alias("f1_raw"), F.col("mean_b").alias("f1_norm"), "delta", "lo", "hi", "p")

    def generative(self, generate: Callable[[DataFrame, DataFrame], DataFrame], metric: str = "rouge1", k: int = 3, seed: int = 42) -> DataFrame:
        """score_raw, score_norm, delta: the mean over folds of what a generator, trained on either side, makes of the held-out texts; needs label, the reference text.

        generate: see generation.generated; metric: rouge1 or bleu.
        """
        d = generation.folds(self.corpus.select(F.col("doc_id").alias("item"), "raw", "norm", F.col("label").cast("string").alias("reference")), "item", k, seed)
        d = materialize(d)
        sides = [generation.scores(generation.generated(d, c, generate, k), metric).withColumnRenamed("score", c) for c in ("raw", "norm")]
        return sides[0].join(sides[1], "fold").agg(F.avg("raw").alias("score_raw"), F.avg("norm").alias("score_norm"), (F.avg("norm") - F.avg("raw")).alias("delta"))

    def evaluate_all(self) -> DataFrame:
        """One row: cr, irs, aes, anld, kl and, with labels, the downstream figures."""
        parts = [self.cr(), self.irs(), self.anld(), self.kl()] + ([self.downstream()] if "label" in self.corpus.columns else [])
        one = F.lit(1).alias("one")
        out = parts[0].select("*", one)
        for p in parts[1:]:
            out = out.join(p.select("*", one), "one")  # of one row each
        gain = vocabulary.vrg(F.col("cr"))
        return out.withColumn("aes", vocabulary.aes(F.col("irs"), gain)).drop("one")
