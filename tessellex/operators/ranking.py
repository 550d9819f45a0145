"""Positions and ranks in large groups: rows are cut into ranges of the order, and each range is numbered by itself.

What a range needs of the others are sums by range, which combine before their shuffle. Ranks work on distinct values; positions cut
values that fill several ranges by a tie. So no task sorts a whole group, equal values or not.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellex.sources.scratch import materialize


#: Distinct values that are worth a range of their own.
VALUES = 50_000
#: A tie above every other: a cut with it stands after all rows of its value.
LAST = 2**63 - 1


def bounds(df: DataFrame, value: str, tie: str | None = None, n: int | None = None) -> list[tuple[float, int]]:
    """About n - 1 cuts of a numeric column, sorted, as (value, tie); n is the number of shuffle partitions where None.

    A value that fills several ranges is cut by tie (a long column), so that equal values spread; without tie they share a range.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    v = F.col(value).cast("double")
    found = df.agg(F.percentile_approx(v, [i / n for i in range(1, n)])).head()[0]  # n numbers
    times = Counter(x for x in found or [] if not math.isnan(x))
    cuts = {(x, LAST) for x in times}
    hot = {x: m for x, m in times.items() if m > 1}
    if tie is None or not hot:
        return sorted(cuts)
    most = max(hot.values()) + 1
    quantiles = F.percentile_approx(F.col(tie).cast("long"), [i / most for i in range(1, most)])
    for r in df.where(v.isin([*hot])).groupBy(v.alias("v")).agg(quantiles.alias("q")).collect():  # n numbers for each of n values at most
        m = hot[r["v"]] + 1
        cuts |= {(r["v"], r["q"][i * most // m - 1]) for i in range(1, m) if i * most // m}
    return sorted(cuts)


def range_of(value: Column, cuts: list[tuple[float, int]], tie: Column | None = None) -> Column:
    """How many of the sorted cuts are below (value, tie), by a binary search in constant arrays; a null value is in the first range.

    Values are compared as doubles: longs that share one must not be told apart by the order either, if tie is given.
    """
    if not cuts:
        return F.lit(0)
    constant = lambda i, kind: F.expr("cast(split('" + ",".join(repr(c[i]) for c in cuts) + f"', ',') as array<{kind}>)")
    values, ties, v = constant(0, "double"), constant(1, "bigint"), value.cast("double")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.getField("lo") + s.getField("hi")) / 2).cast("int")
        below = F.get(values, mid) < v
        if tie is not None:
            below = below | ((F.get(values, mid) == v) & (F.get(ties, mid) < F.coalesce(tie.cast("long"), F.lit(-LAST))))
        on, below = s.getField("lo") < s.getField("hi"), F.coalesce(below, F.lit(False))
        return F.struct(F.when(on & below, mid + 1).otherwise(s.getField("lo")).alias("lo"), F.when(on & ~below, mid).otherwise(s.getField("hi")).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(cuts) + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve).getField("lo")


def _before(df: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    """keys, rk_range, name: the sum of what over the ranges before. The window is over one row a range."""
    each = df.groupBy(*keys, "rk_range").agg(what.alias("rk_n"))
    w = Window.partitionBy(*keys).orderBy("rk_range")
    return each.select(*keys, "rk_range", F.coalesce(F.sum("rk_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))


def positions(df: DataFrame, keys: list[str], ranges: Column, order: list[Column | str], name: str = "pos") -> DataFrame:
    """df with name: 0, 1, ... within keys in the order of (ranges, order). ranges must not contradict the order."""
    d = df.withColumn("rk_range", ranges)
    before = _before(d, keys, F.count("*"), "rk_before")
    own = F.row_number().over(Window.partitionBy(*keys, "rk_range").orderBy(*order)) - 1
    return d.withColumn("rk_own", own).join(before, [*keys, "rk_range"]).withColumn(name, (F.col("rk_own") + F.col("rk_before")).cast("long")).drop("rk_own", "rk_before", "rk_range")


def by_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, rk_n (its rows), rk_all (those of keys), rk_before (those of less value within keys), rk_range; scratch tables count the rows once.

    Equal values are one row, so a value that most rows have costs no more than another, and no range holds more than its share of
    the distinct values.
    """
    each = materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rk_n")))
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + each.count() // VALUES)
    # written with their ranges: the optimizer carries the long expression of a range through the joins below, and loses its columns
    each = materialize(each.withColumn("rk_range", range_of(F.col(value), bounds(each, value, n=n)))) if n > 1 else each.withColumn("rk_range", F.lit(0))
    ranges = Window.partitionBy(*keys).orderBy("rk_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sums = each.groupBy(*keys, "rk_range").agg(F.sum("rk_n").alias("rk_sum"))
    before = sums.select(*keys, "rk_range", F.coalesce(F.sum("rk_sum").over(ranges), F.lit(0)).alias("rk_less"), F.sum("rk_sum").over(Window.partitionBy(*keys)).alias("rk_all"))
    w = Window.partitionBy(*keys, "rk_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = each.withColumn("rk_own", F.coalesce(F.sum("rk_n").over(w), F.lit(0))).join(before, [*keys, "rk_range"])
    return ranks.select(*keys, value, "rk_n", "rk_all", (F.col("rk_less") + F.col("rk_own")).alias("rk_before"), "rk_range")


def midranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with name: the rank from 1 of value within keys, equal values sharing the mean of theirs. Rows without a value or a key go."""
    ranks = by_value(df, keys, value).select(*keys, value, (F.col("rk_before") + (F.col("rk_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*keys, value])


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """df (with rk_range, as by_value returns it) with name: the greatest value up to each row within keys, by rk_range and order."""
    w = Window.partitionBy(*keys).orderBy("rk_range").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*keys, "rk_range").agg(F.max(value).alias("rk_most")).select(*keys, "rk_range", F.max("rk_most").over(w).alias("rk_before_most"))
    own = F.max(value).over(Window.partitionBy(*keys, "rk_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("rk_most", own).join(before, [*keys, "rk_range"]).withColumn(name, F.greatest("rk_most", "rk_before_most")).drop("rk_most", "rk_before_most")
