"""Exact dedup: blocks of texts are sorted into integer names, names of adjacent pairs in turn, until a text has one name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, partitions, table

#: Bytes of a block; its name and its place are 16 bytes.
BLOCK = 1024
#: Pairs that one task sorts, where a level has fewer than would fill all tasks.
PAIRS = 200_000
BLANK = b" \t\n\x0b\x0c\r"

PIECES = "ed_row long, ed_id long, ed_chars long, ed_sha string, ed_pos int, ed_key binary"
NAMED = "ed_row long, ed_id long, ed_chars long, ed_sha string, ed_pos int, ed_part int, ed_local long, ed_shared boolean, ed_edge binary"


def pieces(docs: DataFrame, block: int) -> DataFrame:
    """A row for each block of each normalised text, an empty one for an empty text; the first has what is kept of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            rows, place, keys, shas = [], [], [], []
            for i, text in enumerate(batch.column(3).fill_null("").cast(pa.binary()).to_pylist()):
                text = text.translate(None, BLANK)
                n = max(1, -(-len(text) // block))
                rows += [i] * n
                place += range(n)
                keys += [text[k * block : (k + 1) * block] for k in range(n)]
                shas += [hashlib.sha256(text).hexdigest(), *[None] * (n - 1)]
            at, first = pa.array(rows, pa.int64()), pa.array([p == 0 for p in place])
            once = lambda c: pc.if_else(first, batch.column(c).take(at), pa.nulls(len(rows), pa.int64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), once(1), once(2), pa.array(shas, pa.string()), pa.array(place, pa.int32()), pa.array(keys, pa.binary())], schema=names_of(PIECES))

    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("ed_row"), F.col("doc_id").cast("long").alias("ed_id"), F.char_length(text).cast("long").alias("ed_chars"), text.alias("text"))
    return d.mapInArrow(run, PIECES)


def names_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, sorted by hash and key, with their key's number in the range instead of the key.

    A row that stands beside no other of its hash, or isn't at the end of a batch, is not shared: its key occurs once. Last come
    the keys of the first and of the last hash, which the ranges beside this one may hold, too (ed_edge).
    """
    schema, part = names_of(NAMED), TaskContext.get().partitionId()
    count, hash_, key = 0, None, None  # of the row before
    first: list[tuple[int, bytes]] = []
    last: list[tuple[int, bytes]] = []
    lead = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h = batch.column(5).to_numpy()
        keys = batch.column(6)
        alike = h[1:] == h[:-1]
        new = np.ones(n, bool)
        new[1:] = ~alike
        some = np.flatnonzero(alike)  # only keys of one hash are compared
        if len(some):
            new[some + 1] = pc.not_equal(keys.take(pa.array(some)), keys.take(pa.array(some + 1))).to_numpy(zero_copy_only=False)
        if hash_ is not None:
            new[0] = hash_ != h[0] or key != keys[0].as_py()
        local = count - 1 + np.cumsum(new)
        shared = np.ones(n, bool)
        shared[1:-1] = alike[1:] | alike[:-1]
        if lead is None:
            lead = h[0]
        if h[-1] != hash_:
            last = []
        begun = np.flatnonzero(new)
        if h[0] == lead:
            first += [(int(local[i]), keys[int(i)].as_py()) for i in begun[h[begun] == lead]]
        last += [(int(local[i]), keys[int(i)].as_py()) for i in begun[h[begun] == h[-1]]]
        count, hash_, key = int(local[-1]) + 1, h[-1], keys[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(np.full(n, part, np.int32)), pa.array(local), pa.array(shared), pa.nulls(n, pa.binary())], schema=schema)
    edge = sorted({*first, *last, *([(count - 1, key)] if count else [])})
    blank = [pa.nulls(len(edge), schema.field(i).type) for i in range(5)]
    yield pa.RecordBatch.from_arrays([*blank, pa.array([part] * len(edge), pa.int32()), pa.array([x[0] for x in edge], pa.int64()), pa.nulls(len(edge), pa.bool_()), pa.array([x[1] for x in edge], pa.binary())], schema=schema)


def named(keyed: DataFrame, n: int, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """keyed with ed_name, the place of ed_key among all keys as they are sorted by hash and bytes, and ed_shared.

    The hash only orders: keys of one hash are told apart by their bytes, in all ranges that hold them. Ranges are cut by hash, row and place, so a key that a third of all rows hold fills several ranges. What the driver gets is a row for
    each range, and the numbers of keys that lie in several.
    """
    spark = keyed.sparkSession
    hashed = keyed.select(*[c for c in keyed.columns if c != "ed_key"], hash_of(F.col("ed_key")).cast("long").alias("ed_hash"), "ed_key")
    ranges = hashed.repartitionByRange(n, "ed_hash", "ed_row", "ed_pos").sortWithinPartitions("ed_hash", "ed_key")
    numbers = materialize(ranges.mapInArrow(numbered, NAMED))
    edges = numbers.where(F.col("ed_edge").isNotNull())
    sizes = {r.ed_part: r.n for r in edges.groupBy("ed_part").agg((F.max("ed_local") + 1).alias("n")).collect()}
    before, base = 0, {}
    for part in sorted(sizes):
        base[part] = before
        before += sizes[part]
    places = F.array_sort(F.collect_set(F.struct("ed_part", "ed_local")))
    several = edges.groupBy("ed_edge").agg(places.alias("p")).where(F.size("p") > 1).select("p").collect()
    moved = [(x.ed_part, x.ed_local, base[r.p[0].ed_part] + r.p[0].ed_local) for r in several for x in r.p[1:]]
    bases = spark.createDataFrame(sorted(base.items()), "ed_part int, ed_base long")  # one row a range
    fixed = spark.createDataFrame(moved, "ed_part int, ed_local long, ed_moved long")  # two or so a range
    out = numbers.where(F.col("ed_edge").isNull()).join(F.broadcast(bases), "ed_part").join(F.broadcast(fixed), ["ed_part", "ed_local"], "left")
    return out.withColumn("ed_name", F.coalesce("ed_moved", F.col("ed_base") + F.col("ed_local")))


def pairs_of(docs: DataFrame) -> DataFrame:
    """The adjacent pairs of each document's names as keys; a name without a partner is a key of eight bytes."""
    b = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    at = F.sequence(F.lit(0), F.size("ed_names") - 1, F.lit(2))
    keys = F.transform(at, lambda i: F.concat(b(F.get("ed_names", i)), F.coalesce(b(F.get("ed_names", i + 1)), F.lit(b""))))
    first = lambda c: F.when(F.col("ed_pos") == 0, F.col(c)).alias(c)
    return docs.select("ed_row", "ed_id", "ed_chars", "ed_sha", F.posexplode(keys).alias("ed_pos", "ed_key")).select("ed_row", first("ed_id"), first("ed_chars"), first("ed_sha"), "ed_pos", "ed_key")


def by_document(names: DataFrame, level: int) -> DataFrame:
    """One row a document: its names in order, and whether all of them are shared."""
    array = F.transform(F.array_sort(F.collect_list(F.struct("ed_pos", "ed_name"))), lambda x: x.getField("ed_name"))
    once = [F.max(c).alias(c) for c in ("ed_id", "ed_chars", "ed_sha")]
    return names.groupBy("ed_row").agg(*once, F.min("ed_shared").alias("ed_shared"), array.alias("ed_names")).withColumn("ed_level", F.lit(level))


def name_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a document: ed_row (a number of the row), ed_id (its doc_id), ed_chars (code points of the text), ed_sha (SHA-256 of the
    normalised text) and its identity ed_level, ed_name, which two rows share if and only if their normalised texts are equal; it is null
    for a text that a block or pair of its own tells from all others.

    Blocks of `block` bytes get the integers of their sorted order, the adjacent pairs of names those of theirs, and so
    on until one name is left: a text of 2**k blocks takes k levels. Only bytes and pairs are compared, hashes just order
    them, so no two texts get one identity. A document with a block or pair that occurs once is done; the others go on, and
    so do all copies. One level is a shuffle of its keys by ranges and one of its names by document.
    """
    spark = docs.sparkSession
    level, n, keyed, done = 0, partitions(spark), pieces(docs, block), []
    while True:
        d = materialize(by_document(named(keyed, n), level))
        own = F.when(F.col("ed_shared"), F.get("ed_names", F.lit(0)))
        done.append(d.where(~F.col("ed_shared") | (F.size("ed_names") == 1)).select("ed_row", "ed_id", "ed_chars", "ed_sha", "ed_level", own.alias("ed_name")))
        d = d.where(F.col("ed_shared") & (F.size("ed_names") > 1))
        left = d.agg(F.sum(F.size("ed_names"))).first()[0]
        if not left:
            break
        level, n, keyed = level + 1, min(n, 1 + left // PAIRS), pairs_of(d)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row the row that stays of those with an equal text: doc_id, ed_keep_id, ed_group_size, ed_kept, ed_sha.

    Texts are equal that are the same bytes after all of 20 and 09 to 0D are deleted; a null text is empty, and all empty texts
    are equal. Of a group the row with the most code points in its text stays, then the smallest doc_id (null last), then,
    of rows that repeat an id and a text, any one of them: each group keeps one row. Texts are read whole; a text of any
    length is cut into rows of a block. Other columns don't matter, whatever their names. An empty table gives no rows.

    A group of any size is one row after the partial aggregation; its rows meet it in a join that Spark may split.
    """
    d = name_documents(docs, block)
    same = materialize(d.where(F.col("ed_name").isNotNull()))
    best = F.min(F.struct((-F.col("ed_chars")).alias("n"), F.col("ed_id").isNull().alias("no_id"), F.col("ed_id").alias("id"), F.col("ed_row").alias("row")))
    groups = materialize(same.groupBy("ed_level", "ed_name").agg(best.alias("ed_best"), F.count("*").alias("ed_n")))
    copies = same.join(groups, ["ed_level", "ed_name"]).select(*result(F.col("ed_best.id"), F.col("ed_n"), F.col("ed_row") == F.col("ed_best.row")))
    return d.where(F.col("ed_name").isNull()).select(*result(F.col("ed_id"), F.lit(1), F.lit(True))).unionByName(copies)


def result(keep: Column, n: Column, kept: Column) -> list[Column]:
    return [F.col("ed_id").alias("doc_id"), keep.alias("ed_keep_id"), n.cast("long").alias("ed_group_size"), kept.alias("ed_kept"), F.col("ed_sha")]


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in blocks of 1 KB; nulls, empty and repeated rows are handled as exact_duplicates says."""
    d = exact_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("ed_keep_id").alias("keep_id"), F.col("ed_group_size").alias("group_size"), F.col("ed_kept").alias("kept"), F.col("ed_sha").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
ranked AS (SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS size,
             first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM t)
SELECT doc_id, keep_id, size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(k) AS text_sha256 FROM ranked
"""
