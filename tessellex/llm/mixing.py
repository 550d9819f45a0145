"""Mixing sources to target weights [native]: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import any_names, materialize, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def with_rank(sources: DataFrame) -> DataFrame:
    """sources with mx_rank: 0, 1, ... by mx_source in code point order, null last. No task sees more than its range."""
    order = [F.col("mx_source").isNull(), F.col("mx_source")]
    parts = materialize(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mx_at", F.monotonically_increasing_id()))
    ranges = parts.groupBy(F.shiftright("mx_at", 33).alias("mx_part")).agg(F.count("*").alias("mx_n")).orderBy("mx_part").collect()  # one row a range
    before, offsets = 0, [0] * (1 + max((r.mx_part for r in ranges), default=0))
    for r in ranges:
        offsets[r.mx_part] = before
        before += r.mx_n
    shift = F.get(F.expr("cast(split('" + ",".join(map(str, offsets)) + "', ',') as array<bigint>)"), F.shiftright("mx_at", 33).cast("int"))
    return parts.withColumn("mx_rank", (F.col("mx_at").bitwiseAND((1 << 33) - 1) + shift).cast("long")).drop("mx_at")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (mx_source, mx_size long) with mx_target: shares of the sum of sizes by weight, at most max_epochs times the size.

    Sources that would exceed their cap are clamped to it and the rest is shared anew by weight among the others,
    until none is above. Each round is one aggregate of the sources; only sums come to the driver. A source of size 0
    has target 0.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("mx_rank") % len(weights) + 1).cast("int"))
    s = materialize(with_rank(sources).withColumn("mx_weight", weight.cast("long")).withColumn("mx_cap", F.col("mx_size") * max_epochs))
    total = s.agg(F.coalesce(F.sum("mx_size"), F.lit(0))).head()[0]
    level = None  # words for each unit of weight; sources with cap / weight below it are clamped
    while True:
        clamped = F.lit(False) if level is None else F.col("mx_cap") < F.col("mx_weight") * F.lit(level)
        caps, free = s.agg(F.coalesce(F.sum(F.when(clamped, F.col("mx_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col("mx_weight"))), F.lit(0))).head()
        new = (total - caps) / free if free else 0.0
        if level is not None and new <= level:
            break
        level = new
    clamped = F.col("mx_cap") < F.col("mx_weight") * F.lit(level)
    return s.withColumn("mx_target", F.when(clamped, F.col("mx_cap").cast("double")).otherwise(F.col("mx_weight") * F.lit(level)))


def bin_digits(rows: int) -> int:
    """Hex digits of as many ranges as the square root of rows, 3 to 7."""
    return min(7, max(3, math.ceil(math.log(max(1, rows), 16) / 2)))


@any_names("mx_", "doc_id", "source")
def mix_sources(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Draws documents so that each source's words come to its target.

    Returns doc_id, source, keep, mx_size (words of the text; null or empty: 0), mx_source_size, mx_target, mx_taken
    (long), mx_repeats (double: mx_taken / mx_size, 0 where the size is 0). Every document is taken floor(target /
    source size) times whole. What is then missing comes from the documents in a seeded order (MD5 of seed and
    doc_id), each once more, until the target is reached; the last one is taken in part. So the sum is the target,
    rounded, and no document exceeds max_epochs. Equal doc_ids are ordered by size; rows equal in both are alike.

    The seeded order is cut into as many ranges a source as the square root of all rows, at least 4096; sums of ranges
    combine before their shuffle, and only the one range a source in which the target is reached is sorted. No task gets
    a whole source. Null ids are ordered by a hash of their texts. An empty table gives no rows; texts of any length are
    only counted.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64("text")))))
    d = docs.select("doc_id", "source", *keep, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("mx_size"), order.alias("mx_order"))
    digits = bin_digits(docs.count())
    d = d.withColumn("mx_bin", F.conv(F.substring("mx_order", 1, digits), 16, 10).cast("int"))
    d = materialize(d)
    bins = materialize(d.groupBy(F.col("source").alias("mx_source"), "mx_bin").agg(F.sum("mx_size").alias("mx_bin_size")))
    sources = bins.groupBy("mx_source").agg(F.sum("mx_bin_size").alias("mx_size"))
    filled = water_fill(sources, weights, max_epochs)
    whole = F.when(F.col("mx_size") > 0, F.floor(F.col("mx_target") / F.col("mx_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("mx_whole", whole).withColumn("mx_more", F.floor(F.col("mx_target") - F.col("mx_whole") * F.col("mx_size") + F.lit(0.5)).cast("long"))
    # the range of the order in which the missing words are reached
    w = Window.partitionBy("mx_source").orderBy("mx_bin").rowsBetween(Window.unboundedPreceding, -1)
    run = bins.withColumn("mx_before", F.coalesce(F.sum("mx_bin_size").over(w), F.lit(0)))
    match = F.col("f.mx_source").eqNullSafe(F.col("r.mx_source"))
    edge = filled.alias("f").join(run.alias("r"), match & (F.col("r.mx_before") < F.col("f.mx_more")) & (F.col("r.mx_before") + F.col("r.mx_bin_size") >= F.col("f.mx_more")), "left")
    edge = materialize(edge.select(F.col("f.mx_source").alias("mx_source"), F.col("f.mx_size").alias("mx_source_size"), "mx_target", "mx_whole", "mx_more", F.col("r.mx_bin").alias("mx_edge"), F.col("r.mx_before").alias("mx_before")))
    small = edge.count() <= BROADCAST_SOURCES
    d = d.join(F.broadcast(edge) if small else edge, d["source"].eqNullSafe(edge["mx_source"]))
    inside = d.where(F.col("mx_bin") == F.col("mx_edge"))
    w = Window.partitionBy("mx_source").orderBy("mx_order", "doc_id", "mx_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("mx_extra", F.greatest(F.lit(0), F.least("mx_size", F.col("mx_more") - F.col("mx_before") - F.coalesce(F.sum("mx_size").over(w), F.lit(0)))))
    outside = d.where(~F.coalesce(F.col("mx_bin") == F.col("mx_edge"), F.lit(False))).withColumn("mx_extra", F.when(F.col("mx_bin") < F.col("mx_edge"), F.col("mx_size")).otherwise(F.lit(0)))
    taken = (F.col("mx_whole") * F.col("mx_size") + F.col("mx_extra")).cast("long")
    out = outside.unionByName(inside).withColumn("mx_taken", taken).withColumn("mx_repeats", F.when(F.col("mx_size") > 0, F.col("mx_taken") / F.col("mx_size")).otherwise(F.lit(0.0)))
    return out.select("doc_id", "source", *keep, "mx_size", "mx_source_size", "mx_target", "mx_taken", "mx_repeats")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 by turns, three epochs at most."""
    d = mix_sources(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || doc_id) AS o FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
fill(step, level) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM s)
  UNION ALL
  SELECT step + 1, new FROM (
    SELECT f.step, f.level, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap < weight * f.level), 0))::DOUBLE
      / (sum(weight) FILTER (WHERE NOT cap < weight * f.level))::DOUBLE FROM s) AS new FROM fill f) WHERE new > level),
t AS (
  SELECT source, source_size, CASE WHEN cap < weight * level THEN cap::DOUBLE ELSE weight * level END AS target
  FROM s, (SELECT max(level) AS level FROM fill)),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
v AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, floor(u.target - u.whole * u.source_size + 0.5)::BIGINT AS more,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM v
"""
