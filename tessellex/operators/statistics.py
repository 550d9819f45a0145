"""Paired statistics. Sums and counts are aggregates; tail probabilities come from a Pandas function over the few result rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.functions import probability
from tessellex.sources.scratch import materialize

from . import ranking
from .resampling import bootstrap


def paired(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, mean_a, mean_b, delta, sd, d_z, lo, hi of b - a; sd over n - 1, d_z null where sd is 0, lo and hi the 95 % t-interval of delta."""
    d = F.col(b) - F.col(a)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"))
    half = t95("n") * F.col("sd") / F.sqrt("n")
    return out.withColumn("d_z", F.when(F.col("sd") > 0, F.col("delta") / F.col("sd"))).withColumns({"lo": F.col("delta") - half, "hi": F.col("delta") + half})


def t95(n: str) -> Column:
    """Student's two-sided 95 % quantile for n values; null for fewer than two."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return pd.Series([probability.t_quantile(int(x) - 1) if x > 1 else None for x in n], dtype=float)

    return quantile(n)


def mcnemar(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, a_only, b_only, both, neither, statistic, exact, p of two boolean columns."""
    n = lambda x, y: F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1))
    out = df.groupBy(*keys).agg(n(True, False).alias("a_only"), n(False, True).alias("b_only"), n(True, True).alias("both"), n(False, False).alias("neither"))
    apart = F.col("a_only") + F.col("b_only")
    corrected = F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1, F.lit(2.0)) / apart

    @F.pandas_udf("double")
    def p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([probability.mcnemar(int(i), int(j))[1] for i, j in zip(x, y, strict=True)], dtype=float)

    return out.withColumns({"statistic": F.when(apart < 25, F.least("a_only", "b_only").cast("double")).otherwise(corrected), "exact": apart < 25, "p": p("a_only", "b_only")})


def wilcoxon(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, w, p of the signed ranks of value; a group is a list of folds or items, which is small by its meaning."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        w, p = probability.wilcoxon(g[value].tolist())
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), w, p]], columns=[*keys, "w", "p"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", w double, p double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, p: correlation of midranks, and Student's p."""
    d = materialize(df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    r = ranking.midranks(ranking.midranks(d, keys, x, "rx"), keys, y, "ry") if x != y else ranking.midranks(d, keys, x, "rx").withColumn("ry", F.col("rx"))
    out = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))

    @F.pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else probability.spearman_p(a, int(b)) for a, b in zip(rho, n, strict=True)], dtype=float)

    return out.withColumn("p", p("rho", "n"))


def holm(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """df with p_holm: step-down within keys, a running maximum, at most 1. Rows without a p or a key go.

    Of equal p the first step is the greatest, so they share its value: the steps are over distinct p.
    """
    each = ranking.by_value(df, keys, p)
    each = each.withColumn("rk_step", F.least(F.lit(1.0), F.col(p) * (F.col("rk_all") - F.col("rk_before"))))
    return df.join(ranking.running_max(each, keys, p, "rk_step", "p_holm").select(*keys, p, "p_holm"), [*keys, p])


def comparison(df: DataFrame, keys: list[str], a: str, b: str, item: str, n_boot: int = 10_000) -> DataFrame:
    """keys, delta, lo, hi, a_only, b_only, statistic, exact, p of two paired ranks: the change of the reciprocal rank up to ten with its
    bootstrap interval, and McNemar's test of rank one.
    """
    rr = lambda c: F.when(F.col(c) <= 10, 1 / F.col(c)).otherwise(0.0)
    d = df.withColumn("cp_key", F.lit(0))  # so that a join has a key
    by = ["cp_key", *keys]
    ci = bootstrap(d.select(*by, item, (rr(b) - rr(a)).alias("cp_d")), by, "cp_d", item, n_boot).drop("n").withColumnRenamed("mean", "delta")
    test = mcnemar(d.select(*by, (F.col(a) == 1).alias("x"), (F.col(b) == 1).alias("y")), by, "x", "y")
    return test.join(ci, by).select(*keys, "delta", "lo", "hi", "a_only", "b_only", "statistic", "exact", "p")
