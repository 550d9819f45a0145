"""Scores of generated texts: BLEU as sums that merge, ROUGE-1, and a cross-validated comparison of generators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessellex.functions import text

from . import learning, ranking

ORDER = 4


@F.pandas_udf(ArrayType(LongType()))
def _hits(made: pd.Series, reference: pd.Series, order: pd.Series) -> pd.Series:
    def of(a: np.ndarray, b: np.ndarray, top: int) -> list[int]:
        grams = lambda t, n: Counter(zip(*(t[i:] for i in range(n)), strict=False))
        a, b = list(a), list(b)
        return [(grams(a, n) & grams(b, n)).total() for n in range(1, top + 1)]

    return pd.Series([of(*x) for x in zip(made, reference, order, strict=True)], index=made.index, dtype=object)


def gram_counts(made: Column, reference: Column, order: int = ORDER) -> Column:
    """made_length, reference_length, hits and totals of one text, two arrays of tokens; a null side is empty."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (made, reference))
    totals = F.array(*[F.greatest(F.size(a) - n + 1, F.lit(0)).cast("long") for n in range(1, order + 1)])
    return F.struct(F.size(a).cast("long").alias("made_length"), F.size(b).cast("long").alias("reference_length"), _hits(a, b, F.lit(order)).alias("hits"), totals.alias("totals"))


def summed(texts: DataFrame, keys: list[str], counts: str, order: int = ORDER) -> DataFrame:
    """keys and the sums of gram_counts, a column of texts."""
    at = lambda c: F.array(*[F.coalesce(F.sum(F.get(F.col(f"{counts}.{c}"), F.lit(n))), F.lit(0)) for n in range(order)]).alias(c)
    return texts.groupBy(*keys).agg(*[F.sum(f"{counts}.{c}").alias(c) for c in ("made_length", "reference_length")], at("hits"), at("totals"))


def bleu_counts(pairs: DataFrame, keys: list[str], item: str, made: str, reference: str, order: int = ORDER) -> DataFrame:
    """keys, made_length, reference_length, hits and totals (arrays by n): the sums that BLEU needs, which add up over any parts of a corpus.

    made and reference are arrays of tokens; an n-gram of a made text counts as often as the reference has it at most. A row is a text, named by
    item, and holds both sides, so its n-grams are counted where it is and only numbers are shuffled. A null side is empty.
    """
    return summed(pairs.select(*keys, item, gram_counts(F.col(made), F.col(reference), order).alias("bl_counts")), keys, "bl_counts", order)


def bleu(counts: DataFrame, order: int = ORDER) -> Column:
    """0 to 100 from the columns of bleu_counts: the geometric mean of precisions times the brevity penalty.

    The first order without a hit counts as half a hit, the second as a quarter, and so on; an order without n-grams makes it 0.
    """
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("share"), F.lit(False).alias("none"))

    def step(s: Column, n: Column) -> Column:
        hits, total = F.get("hits", n), F.get("totals", n)
        share = F.when(hits == 0, s["share"] / 2).otherwise(s["share"])
        value = F.when(hits == 0, share).otherwise(hits) / F.greatest(total, F.lit(1))
        return F.struct((s["log"] + F.log(value)).alias("log"), share.alias("share"), (s["none"] | (total == 0)).alias("none"))

    s = F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step)
    penalty = F.when(F.col("made_length") >= F.col("reference_length"), 1.0).otherwise(F.exp(1 - F.col("reference_length") / F.greatest("made_length", F.lit(1))))
    return F.when(s["none"], 0.0).otherwise(100 * penalty * F.exp(s["log"] / order))


def folds(df: DataFrame, item: str, k: int = 3, seed: int = 42) -> DataFrame:
    """df with fold: items in a seeded order, dealt to k folds by turns."""
    d = df.withColumn("fold_order", learning.order_hash(F.col(item), seed))
    d = ranking.positions(d, [], F.conv(F.substring("fold_order", 1, 3), 16, 10).cast("int"), ["fold_order", item], "fold_at")
    return d.withColumn("fold", (F.col("fold_at") % k).cast("int")).drop("fold_order", "fold_at")


Generator = Callable[[DataFrame, DataFrame], DataFrame]


def generated(corpus: DataFrame, side: str, generate: Generator, k: int = 3, seed: int = 42) -> DataFrame:
    """item, fold, made, reference: what generate makes of each fold's texts after it has seen the others.

    corpus: item, fold, reference and the texts in the column side. generate takes (item, text, reference) of the training side and (item, text) of the
    test side, and returns item and made.
    """
    out = None
    for f in range(k):
        train, test = corpus.where(F.col("fold") != f), corpus.where(F.col("fold") == f)
        made = generate(train.select("item", F.col(side).alias("text"), "reference"), test.select("item", F.col(side).alias("text")))
        part = test.select("item", "fold", "reference").join(made.select("item", "made"), "item", "left")
        out = part if out is None else out.unionByName(part)
    return out


def scores(made: DataFrame, metric: str) -> DataFrame:
    """fold, score of (item, fold, made, reference): rouge1 (mean F1 of words, 0 to 1) or bleu (of the fold's corpus, 0 to 100)."""
    cut = made.select("item", "fold", text.tokenize(F.coalesce("made", F.lit(""))).alias("made"), text.tokenize(F.coalesce("reference", F.lit(""))).alias("reference"))
    if metric == "rouge1":
        return cut.groupBy("fold").agg(F.avg(text.rouge1(F.col("made"), F.col("reference"))).alias("score"))
    counts = bleu_counts(cut, ["fold"], "item", "made", "reference")
    return counts.select("fold", bleu(counts).alias("score"))
