"""Ranks and positions of groups most of whose values are equal."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellex.operators import ranking, statistics


def ties(spark, n=20_000):
    """Nine in ten values are 1.0, as Holm's p-values mostly are."""
    rng = random.Random(6)
    rows = [(i, 1.0 if rng.random() < 0.9 else rng.random()) for i in rng.sample(range(n), n)]
    return rows, spark.createDataFrame(rows, "i long, p double")


def test_positions_spread_ties(spark):
    rows, df = ties(spark)
    cuts = ranking.bounds(df, "p", "i", 16)
    ranges = ranking.range_of(F.col("p"), cuts, F.col("i"))
    sizes = [r["n"] for r in df.groupBy(ranges.alias("r")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * len(rows) / len(sizes)
    got = {r["i"]: r["pos"] for r in ranking.positions(df, [], ranges, ["p", "i"]).collect()}
    assert [got[i] for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] == list(range(len(rows)))
    # without a tie all equal values share a range
    alone = df.groupBy(ranking.range_of(F.col("p"), ranking.bounds(df, "p", n=16)).alias("r")).count().collect()
    assert max(r["count"] for r in alone) >= 0.89 * len(rows)


@pytest.mark.parametrize("values", [10, 50_000])
def test_ranks_of_ties(spark, monkeypatch, values):
    """Equal values are one row, so ranges hold distinct values; two hot values, nulls and repeated ids, too."""
    monkeypatch.setattr(ranking, "VALUES", values)
    rows, df = ties(spark, 5000)
    df = df.withColumn("g", F.lit("a")).unionByName(df.select("i", F.when(F.col("i") % 2 == 0, F.col("p")).otherwise(0.5).alias("p"), F.lit("b").alias("g"))).unionByName(df.limit(3).select("i", F.lit(None).cast("double").alias("p"), F.lit("a").alias("g")))
    by = {"a": [p for _, p in rows], "b": [p if i % 2 == 0 else 0.5 for i, p in rows]}
    each = ranking.by_value(df, ["g"], "p")
    for g, own in by.items():
        counts = Counter(own)
        got = {r["p"]: (r["rk_n"], r["rk_before"]) for r in each.where(F.col("g") == g).collect()}
        before = 0
        for p in sorted(counts):
            assert got[p] == (counts[p], before)
            before += counts[p]
    sizes = [r["n"] for r in each.groupBy("g", "rk_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) <= 3 * each.count() / len(sizes) if values == 10 else len(sizes) == 2
    holm = {(r["g"], r["i"]): r["p_holm"] for r in statistics.holm(df, ["g"], "p").collect()}
    for g, of in (("a", dict(rows)), ("b", {i: p if i % 2 == 0 else 0.5 for i, p in rows})):
        most = 0.0
        for k, (p, i) in enumerate(sorted((p, i) for i, p in of.items())):
            most = max(most, min(1.0, p * (len(of) - k)))
            assert abs(holm[g, i] - most) < 1e-12
    assert len(holm) == 2 * len(rows)
