"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of the test items. A block of two words at the end of the current position looks up how
far the position may move without passing an occurrence; only where that is nothing, the bucket of windows with this
suffix hash is compared, first by its prefix, then word by word.
"""

from __future__ import annotations

import math
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, append_columns, table

#: Words of a lane. Lanes of one chunk advance together, each by its own shifts.
LANE = 512
#: Bytes of test texts whose tables one broadcast holds, and blocks that one pass over the documents searches: a task
#: holds the tables of TOGETHER * BLOCK_BYTES of items at most, and more items take more passes.
BLOCK_BYTES, TOGETHER = 4 << 20, 4


def word_table() -> bytes:
    """For bytes.translate: A-Z lower-cased, and a space for each byte that is no digit, letter or part of a longer character."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None, to: bytes) -> list[bytes]:
    return text.encode().translate(to).split() if text else []


def block_hash(ids: np.ndarray, at: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hash of the block of width words that ends at each position."""
    h = ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if width > 1:
        h += ids[at - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def build(items: list[tuple[str | None, str | None]], window: int) -> dict:
    """The tables for a block of items: plain dicts and arrays, one searcher for each length of window."""
    to, vocabulary, by_length = word_table(), {}, {}
    names = sorted({i for i, _ in items if i is not None})
    number = {n: k for k, n in enumerate(names)}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text, to)]
        m = min(window, len(ids))
        if m:
            found = by_length.setdefault(m, {})
            for i in range(len(ids) - m + 1):
                found.setdefault(tuple(ids[i : i + m]), set()).add(number.get(item, -1))
    searchers = []
    for m, found in sorted(by_length.items()):
        patterns = np.array(list(found), np.int32)
        width = min(2, m)
        bits = min(22, max(10, math.ceil(math.log2(4 * patterns.size))))
        shift = np.full(1 << bits, m - width + 1, np.int32)
        flat = patterns.ravel()
        for j in range(width - 1, m):
            np.minimum.at(shift, block_hash(flat, np.arange(len(patterns)) * m + j, width, bits), m - 1 - j)
        suffix = block_hash(flat, np.arange(len(patterns)) * m + m - 1, width, bits)
        order = np.argsort(suffix, kind="stable")
        patterns, owners = patterns[order], [sorted(list(found.values())[k]) for k in order]
        buckets = np.concatenate(([0], np.cumsum(np.bincount(suffix, minlength=1 << bits))))
        searchers.append({"m": m, "width": width, "bits": bits, "shift": shift, "buckets": buckets, "patterns": patterns, "owners": owners})
    return {"vocabulary": vocabulary, "names": names, "searchers": searchers}


def occurrences(ids: np.ndarray, first: np.ndarray, last: np.ndarray, s: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, pattern) of every occurrence in the texts ids[first[i]:last[i]]; none crosses texts."""
    m, width, bits = s["m"], s["width"], s["bits"]
    long = last - first >= m
    begin, end = first[long] + m - 1, last[long]
    lanes = -(-(end - begin) // LANE)
    text = np.repeat(np.arange(len(begin)), lanes)
    cur = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    stop = np.minimum(cur + LANE, end[text])
    starts, patterns = [], []
    while len(cur):
        h = block_hash(ids, cur, width, bits)
        move = s["shift"][h]
        if len(hit := np.flatnonzero(move == 0)):
            at, h = cur[hit], h[hit]
            low, n = s["buckets"][h], s["buckets"][h + 1] - s["buckets"][h]
            pick = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at - m + 1, n)
            same = s["patterns"][pick, 0] == ids[at]
            pick, at = pick[same], at[same]
            same = (s["patterns"][pick] == ids[at[:, None] + np.arange(m)]).all(axis=1)
            starts.append(at[same])
            patterns.append(pick[same])
        cur = cur + np.maximum(move, 1)
        on = cur < stop
        cur, stop = cur[on], stop[on]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *patterns])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@any_names("dc_")
def find_items(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id where None), then dc_n_words (long), dc_hits (array of struct start, end) and dc_items (sorted strings).

    dc_hits are the merged runs of words, by number and end exclusive, inside an occurrence of window words in a row of
    an item; an item of fewer words, but not none, is one window. dc_items are the item_ids of these windows. Null and
    empty texts have no words; items without words have no windows. Windows of a null item_id mark words without a
    name. Repeated item_ids are one item, repeated documents are searched each; texts of any length are searched whole, and
    empty tables give no rows or no hits. docs are read once and not shuffled; the items are read once and come in blocks
    of about block_bytes to the driver and to each executor.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block")
    rows = items.where(F.col("text").isNotNull()).select(block, F.col("item_id").cast("string").alias("item_id"), "text")
    rows = rows.orderBy("block") if blocks > 1 else rows
    tables = [spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in own], window)) for _, own in groupby(rows.toLocalIterator(), key=lambda r: r.block)]
    out, state = docs.select(*dict.fromkeys([*keep, "text"])), ()
    fields = [T.StructField("dc_n_words", T.LongType()), T.StructField("dc_hits", HITS), T.StructField("dc_items", T.ArrayType(T.StringType()))]
    groups = [tables[i : i + TOGETHER] for i in range(0, len(tables), TOGETHER)] or [[]]
    for i, group in enumerate(groups):
        out = append_columns(out, search(group, state), fields, keep=list(dict.fromkeys([*keep, *(["text"] if i + 1 < len(groups) else [])])))
        state = ("dc_hits", "dc_items")
    return out.select(*keep, "dc_n_words", "dc_hits", "dc_items")


def search(tables: list, state: tuple[str, ...]):
    """For append_columns: what the broadcast tables find, beside what the columns in state hold."""

    def make():
        to = word_table()

        def work(batch: pa.RecordBatch) -> dict:
            words = [words_of(x, to) for x in batch.column("text").to_pylist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            last = np.cumsum(size)
            hits, found = [[] for _ in words], [set() for _ in words]
            if state:
                for i, (h, k) in enumerate(zip(batch.column("dc_hits").to_pylist(), batch.column("dc_items").to_pylist(), strict=True)):
                    hits[i], found[i] = [(x["start"], x["end"]) for x in h], set(k)
            for shared in tables:
                t = shared.value
                ids = np.fromiter(map(t["vocabulary"].get, chain.from_iterable(words), repeat(0)), np.int32, int(size.sum()))
                for s in t["searchers"]:
                    at, which = occurrences(ids, last - size, last, s)
                    text = np.searchsorted(last, at, side="right")
                    for i, a, k in zip(text.tolist(), (at - (last - size)[text]).tolist(), which.tolist(), strict=True):
                        hits[i].append((a, a + s["m"]))
                        found[i].update(t["names"][o] for o in s["owners"][k] if o >= 0)
            spans = [[{"start": a, "end": e} for a, e in merged(h)] for h in hits]
            return {"dc_n_words": size, "dc_hits": spans, "dc_items": [sorted(f) for f in found]}

        return work

    return make


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of benchmark, with windows of ten words."""
    d = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("dc_hits", F.lit(0).cast("long"), lambda s, x: s + x.getField("end") - x.getField("start"))
    return d.select(
        "doc_id", F.col("dc_n_words").alias("n_words"), hit.alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"), (F.size("dc_hits") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM iwin) WHERE len(w) >= m)),
occ AS (SELECT dwin.doc_id, iwin.item_id, dwin.i, dwin.m FROM dwin JOIN iwin ON dwin.g = iwin.g AND dwin.m = iwin.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
