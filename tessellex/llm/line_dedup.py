"""Line dedup [native]: explode normalised lines, hash, count distinct documents a hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, any_names, lower_ascii, materialize, table

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without spaces (20, 09 to 0D) at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


@any_names("ld_", "doc_id", "text")
def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines that at least min_docs documents hold, except in the smallest doc_id that holds them.

    Returns doc_id, the columns named in keep, and ld_n_lines, ld_n_dropped (long), ld_text (the lines that stay,
    joined by newlines). A null or empty text is one empty line. Keys of fewer than min_chars code points stay. A null
    doc_id counts as the largest id; rows that share a doc_id are one document for the counts, and each such row keeps
    its own lines. Repeats of a line within the smallest document stay. Texts of any length are split whole; an empty table
    gives no rows.

    The keys travel as 128 bits of hash with their document, once, in a scratch table; the counts combine before the
    shuffle, so a line that a third of all documents hold is one row a task. The texts are shuffled once, to
    their own dropped positions.
    """
    base = docs.select("doc_id", *keep, "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("ld_id"), F.xxhash64("text").alias("ld_row"))
    lines = base.select("ld_id", "ld_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ld_pos", "ld_line"))
    keyed = lines.select("ld_id", "ld_row", "ld_pos", line_key(F.col("ld_line")).alias("ld_key")).where(F.char_length("ld_key") >= min_chars)
    keyed = materialize(keyed.select("ld_id", "ld_row", "ld_pos", F.xxhash64("ld_key").alias("ld_h1"), F.xxhash64(F.lit(1), "ld_key").alias("ld_h2")))
    held = keyed.groupBy("ld_h1", "ld_h2")
    if min_docs <= 2:  # two distinct documents hold it where the smallest id isn't the largest
        common = held.agg(F.min("ld_id").alias("ld_first"), F.max("ld_id").alias("ld_last")).where(F.lit(min_docs < 2) | (F.col("ld_first") < F.col("ld_last")))
    else:
        common = held.agg(F.min("ld_id").alias("ld_first"), F.count_distinct("ld_id").alias("ld_n")).where(F.col("ld_n") >= min_docs)
    common = materialize(common)  # so that the join's sides are plain exchanges, whose skewed partitions Spark splits
    dropped = keyed.join(common, ["ld_h1", "ld_h2"]).where(F.col("ld_id") != F.col("ld_first"))
    # one row of many equal ones may come more than once: positions are a set
    dropped = dropped.groupBy("ld_id", "ld_row").agg(F.collect_set("ld_pos").alias("ld_drop"))
    both = base.join(dropped, ["ld_id", "ld_row"], "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("ld_parts") - 1), F.col("ld_drop"))
    out = both.withColumn("ld_parts", F.when(F.col("ld_drop").isNotNull(), parts))
    kept = F.when(F.col("ld_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("ld_parts", i)), "\n"))
    n_lines = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return out.select("doc_id", *keep, n_lines.cast("long").alias("ld_n_lines"), F.coalesce(F.size("ld_drop"), F.lit(0)).cast("long").alias("ld_n_dropped"), kept.alias("ld_text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, keys of ten code points in two documents or more; the kept text as its digest."""
    d = dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line,
    translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (SELECT k, min(doc_id) AS first_id FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id <> c.first_id AS gone
           FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
