"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shingler, chunks, partitions, table

#: One in SCALE shingle hashes is retained.
SCALE = 4


def sketches(texts: pa.Array, shingler: Shingler, scale: int = SCALE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the sorted distinct hashes of its shingles below 2**64 / scale, and, as an array of one or none, its least hash; both cut to 48 bits.

    The sketch of a union of shingle sets is the union of their sketches. The least hash is no part of a sketch: it tells texts
    apart that have shingles, but none below the threshold.
    """
    hashes, bounds = shingler(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    low = hashes < np.uint64((1 << 64) // scale)
    kept, at = hashes[low] >> np.uint64(16), np.concatenate(([0], np.cumsum(np.bincount(own[low], minlength=len(texts)))))
    least = [hashes[a:z].min(keepdims=True) >> np.uint64(16) if z > a else np.zeros(0, np.uint64) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return [np.unique(kept[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], least


def merge(parts: list[np.ndarray]) -> np.ndarray:
    """The sketch of several documents together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of the Jaccard similarity of two texts, or merged groups of texts, and of the share of a's shingles that are in b.

    Two empty sketches are equal: 1 and 1. An empty one has nothing in common with one that isn't.
    """
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common), common / len(a)


def bucket_of(id_: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts (id, tie) are below (id_, tie): a binary search in constant arrays."""
    if not cuts:
        return F.lit(0)
    ids, ties = (F.expr("cast(split('" + ",".join(str(c[i]) for c in cuts) + "', ',') as array<bigint>)") for i in (0, 1))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.getField("lo") + s.getField("hi")) / 2).cast("int")
        below = (F.get(ids, mid) < id_) | ((F.get(ids, mid) == id_) & (F.get(ties, mid) < tie))
        on = s.getField("lo") < s.getField("hi")
        return F.struct(F.when(on & below, mid + 1).otherwise(s.getField("lo")).alias("lo"), F.when(on & ~below, mid).otherwise(s.getField("hi")).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(cuts) + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve).getField("lo")


def with_next(docs: DataFrame, per_range: int = 50) -> DataFrame:
    """(fp_bucket, fp_guest, fp_id, fp_tie, doc_id, text) in ranges of doc_id, descending; after a range's rows stands the row that follows them.

    One shuffle of the texts, one range a task. Null ids come last. Equal ids are ordered by a hash of their texts, and
    ranges may cut between them, so that neither null ids nor a repeated one fill one task. The first rows of a range
    go to the range before, too; after the last range comes the first. Only cuts come to the driver, found in
    a sample of about per_range keys a range, and the first key of each range.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("fp_id"), F.xxhash64(text).alias("fp_tie"))
    n = partitions(spark)
    share = min(1.0, per_range * n / max(1, docs.count()))
    sample = d.select("fp_id", "fp_tie").where(F.pmod(F.xxhash64("fp_tie", "fp_id"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()  # per_range * n rows or so
    keys = sorted({(r.fp_id, r.fp_tie) for r in sample})
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    d = d.withColumn("fp_own", bucket_of(F.col("fp_id"), F.col("fp_tie"), cuts))
    tops = sorted((r.fp_own, r.top.fp_id, r.top.fp_tie) for r in d.groupBy("fp_own").agg(F.max(F.struct("fp_id", "fp_tie")).alias("top")).collect())
    above = [(i, t, tops[(k + 1) % len(tops)][0]) for k, (_, i, t) in enumerate(tops)]
    guests = spark.createDataFrame(above, "fp_id long, fp_tie long, fp_host int")  # one row a range: its size is the number of shuffle partitions at most
    d = d.join(F.broadcast(guests), ["fp_id", "fp_tie"], "left")
    own = F.struct(F.col("fp_own").alias("fp_bucket"), F.lit(0).alias("fp_guest"))
    places = F.when(F.col("fp_host").isNotNull(), F.array(own, F.struct(F.col("fp_host").alias("fp_bucket"), F.lit(1).alias("fp_guest")))).otherwise(F.array(own))
    d = d.select(F.explode(places).alias("p"), "fp_id", "fp_tie", "doc_id", "text").select("p.fp_bucket", "p.fp_guest", "fp_id", "fp_tie", "doc_id", "text")
    return d.repartitionById(n, "fp_bucket").sortWithinPartitions("fp_bucket", "fp_guest", F.desc("fp_id"), F.desc("fp_tie"), "text")


FIELDS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("fp_n_chars", T.LongType()), T.StructField("fp_edited_sha256", T.StringType()), T.StructField("fp_sketch", T.ArrayType(T.LongType())), T.StructField("fp_edited_sketch", T.ArrayType(T.LongType())), T.StructField("fp_least", T.LongType()), T.StructField("fp_edited_least", T.LongType())]
    + [T.StructField(f"fp_{a}_{b}", T.DoubleType()) for a in ("near", "inside") for b in ("edited", "next")]
)


def fingerprint_and_compare(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """A sketch of each whole text, and its likeness to an edited text and to the next document's.

    Returns doc_id, fp_n_chars (code points), fp_sketch and fp_edited_sketch (sorted hashes; they merge by union), fp_least
    and fp_edited_least (the least hash of all, null without shingles), fp_edited_sha256, fp_near_edited and fp_near_next
    (Jaccard estimates), fp_inside_edited and fp_inside_next (share of the document's shingles there). Where a text has
    shingles, but none in its sketch, its least hash stands for it in the estimates. The next document is the one with the next smaller doc_id (after the last: the first of
    all); the edited text has its last half replaced by as many code points from the next one's start. A null text is
    empty, null ids come last, equal ids follow each other by a hash of their texts; a lone document is its own next, an
    empty table gives no rows. Shingles are of five words as in op8; a text of fewer words is one shingle, one without
    words has an empty sketch and no least hash. Very long texts are hashed whole, about 50 bytes of memory for each of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, shingler = to_arrow_schema(FIELDS), Shingler()
        held = None
        for batch in chunks(batches, limit=1 << 20):
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            rows = batch.num_rows
            bucket, guest = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = [i for i in range(rows - 1) if not guest[i]]
            held = batch.slice(rows - 1)
            if at:
                yield compared(batch, at, bucket, schema, shingler, scale)

    return with_next(docs).mapInArrow(run, FIELDS)


def compared(batch: pa.RecordBatch, at: list[int], bucket: list[int], schema: pa.Schema, shingler: Shingler, scale: int) -> pa.RecordBatch:
    texts = batch.column(5).to_pylist()
    edited = []
    for i in at:
        assert bucket[i] == bucket[i + 1], "a range without the row that follows it"
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    plain, least = sketches(batch.column(5), shingler, scale)
    changed, changed_least = sketches(pa.array(edited, pa.string()), shingler, scale)
    stands = lambda sketch, low: sketch if len(sketch) else low
    mine, other = [stands(*x) for x in zip(plain, least, strict=True)], [stands(*x) for x in zip(changed, changed_least, strict=True)]
    near = [(likeness(mine[i], c), likeness(mine[i], mine[i + 1])) for i, c in zip(at, other, strict=True)]
    one = lambda x: int(x[0]) if len(x) else None
    columns = [
        batch.column(4).take(pa.array(at)),
        [len(texts[i]) for i in at],
        [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        [plain[i].astype(np.int64) for i in at],
        [c.astype(np.int64) for c in changed],
        [one(least[i]) for i in at],
        [one(c) for c in changed_least],
        *[[n[k][j] for n in near] for j in (0, 1) for k in (0, 1)],
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a sketch is written as its hashes, and as least:hash where a text has shingles, but none below the threshold."""
    d = fingerprint_and_compare(table(spark, sf_dir, "documents"))
    number = lambda h: F.lpad(F.lower(F.hex(h)), 12, "0")
    text = lambda c, least: F.when(F.size(c) > 0, F.array_join(F.transform(c, number), ",")).otherwise(F.coalesce(F.concat(F.lit("least:"), number(F.col(least))), F.lit("")))
    return d.select(
        "doc_id", F.col("fp_n_chars").alias("n_chars"), F.col("fp_edited_sha256").alias("edited_sha256"), text("fp_sketch", "fp_least").alias("fingerprint"), text("fp_edited_sketch", "fp_edited_least").alias("edited_fingerprint"),
        F.col("fp_near_edited").alias("near_edited"), F.col("fp_near_next").alias("near_next"), F.col("fp_inside_edited").alias("inside_edited"), F.col("fp_inside_next").alias("inside_next"),
    )
