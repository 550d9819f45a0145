"""MinHash near-dedup with sequential Bayesian verification.

Bands of MinHash values propose pairs. Batches of signature values are compared one after the other, and a pair goes
as soon as the posterior probability of a similarity of at least the threshold falls below the miss probability; what is
left is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shingler, append_columns, materialize, mix, partitions, table
from .graph import components

ROWS = 3
SIGNATURE, BATCH = 128, 32
MISS = 1e-6
#: Buckets up to so many members give their pairs, each verified in a row of its own; larger ones are joined in blocks.
SMALL = 16
#: A block ends at so many members or shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def bands(percent: int) -> int:
    """The least number of bands of ROWS values that misses a pair at the threshold with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_matches(percent: int) -> list[tuple[int, int]]:
    """(n, m): with fewer than m matches in the first n values, P(similarity >= threshold) is below MISS.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = (1 - t) ** (n + 1), 0
        while tail < MISS:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (signatures; b may be one) that no batch prunes, and their matches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in limits:
        other = b[alive, done:n] if b.ndim == 2 else b[done:n]
        matches = matches + (a[alive, done:n] == other).sum(axis=1)
        stay = matches >= m
        alive, matches, done = alive[stay], matches[stay], n
    return alive, matches


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On the full sets, as sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


BASE = [T.StructField("nd_n", T.LongType()), T.StructField("nd_set", T.BinaryType()), T.StructField("nd_bands", T.ArrayType(T.LongType())), T.StructField("nd_sig", T.BinaryType())]


def sign(percent: int, k: int):
    """For append_columns: size of the shingle set, a digest of it, keys of the bands and the signature."""

    def make():
        shingler, count = Shingler(k), bands(percent)
        rng = np.random.default_rng(8)
        factor = rng.integers(1, 1 << 63, max(SIGNATURE, count * ROWS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, len(factor), np.int64).astype(np.uint64)

        def work(batch: pa.RecordBatch) -> dict:
            hashes, at = shingler(batch.column(batch.schema.get_field_index("text")))
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            least = np.empty((len(factor), len(full)), np.uint64)
            for j, (f, p) in enumerate(zip(factor, plus, strict=True)):
                least[j] = np.minimum.reduceat(hashes * f + p, at[:-1][full]) if len(full) else 0
            least = mix(least)
            keys = np.zeros((count, len(full)), np.uint64)
            for i in range(count):
                for r in range(ROWS):
                    keys[i] = mix(keys[i] * np.uint64(31) + least[i * ROWS + r] + np.uint64(i))
            keys, short = keys.T.astype(np.int64), np.ascontiguousarray((least[:SIGNATURE].T >> np.uint64(48)).astype(np.uint16))
            out = {"nd_n": [0] * len(sizes), "nd_set": [None] * len(sizes), "nd_bands": [None] * len(sizes), "nd_sig": [None] * len(sizes)}
            for x, i in enumerate(full.tolist()):
                own = np.unique(hashes[at[i] : at[i + 1]])
                out["nd_n"][i], out["nd_set"][i] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                out["nd_bands"][i], out["nd_sig"][i] = keys[x], short[x].tobytes()
            return out

        return work

    return make


CANDIDATES = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("block", T.IntegerType())])


def bucket_candidates(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size) with equal keys together, as a stream: pairs of small buckets, and members of larger ones with the number of their block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(CANDIDATES)
    key, group, seen, out = None, [], 0, []
    block, members, filled = 0, 0, 0

    def flush() -> None:
        if 1 < len(group) and seen <= SMALL:
            out.extend((key, min(a, b), max(a, b), None) for i, (a, _) in enumerate(group) for b, _ in group[i + 1 :])

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for k, node, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != key:
                flush()
                key, group, seen = k, [], 0
                block, members, filled = 0, 0, 0
            seen += 1
            if members >= most or members and filled + size > BLOCK_SHINGLES:
                block, members, filled = block + 1, 0, 0
            members, filled = members + 1, filled + size
            if seen <= SMALL:
                group.append((node, block))
            else:
                if seen == SMALL + 1:
                    out.extend((key, g, None, b) for g, b in group)
                out.append((key, node, None, block))
        if len(out) > 50_000:
            yield made()
    flush()
    yield made()


def sets_of(texts: list[str], shingler: Shingler) -> list[np.ndarray]:
    hashes, at = shingler(pa.array(texts, pa.string()))
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(texts))]


def confirm_pairs(percent: int, k: int):
    """For append_columns over (u, v, text, text_v): whether the full sets are linked."""

    def make():
        shingler = Shingler(k)

        def work(batch: pa.RecordBatch) -> dict:
            a, b = (sets_of(batch.column(batch.schema.get_field_index(c)).to_pylist(), shingler) for c in ("text", "text_v"))
            return {"ok": [linked(x, y, percent) for x, y in zip(a, b, strict=True)]}

        return work

    return make


def join_members(percent: int, k: int, across: bool):
    """For applyInArrow over members of a bucket: links that connect all that is connected there.

    Without across, the rows are one block, and all its pairs are compared. With across, the rows are some strays (left)
    and a block (the others), and pairs of different blocks and different roots are compared. A pair that shares an
    earlier band is compared there, but where a bucket has several blocks, one block compares all it has, so that the
    blocks of different bands link each other. Likely pairs come first, and a pair that links confirmed before already
    connect isn't verified again.
    """
    limits = least_matches(percent)

    def work(rows: pa.Table) -> pa.Table:
        shingler = Shingler(k)
        rows = rows.combine_chunks().to_batches()[0]
        get = lambda name: rows.column(name).to_pylist()
        key, nodes, roots, block, stray, left = rows.column("key")[0].as_py(), *(np.array(get(c)) for c in ("node", "root", "block", "stray", "left"))
        sig = np.frombuffer(b"".join(get("sig")), np.uint16).reshape(len(nodes), SIGNATURE)
        keys = np.array(get("bands"), np.int64)
        earlier = int(np.flatnonzero((keys == key).all(axis=0))[0]) if across or rows.column("last")[0].as_py() == 0 else 0
        sets = sets_of(get("text"), shingler)
        first: dict[int, int] = {}
        root = [first.setdefault(r, x) for x, r in enumerate(roots.tolist())] if across else list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        xs, ys, score = [], [], []
        members = np.flatnonzero(~left) if across else np.arange(len(nodes))
        for x in np.flatnonzero(left).tolist() if across else range(len(nodes)):
            if across:  # two strays meet twice: the one of the smaller id is left
                others = members[(roots[members] != roots[x]) & (block[members] != block[x]) & (~stray[members] | (nodes[members] > nodes[x]))]
            else:
                others = members[x + 1 :]
            if earlier and len(others):
                others = others[~(keys[others, :earlier] == keys[x, :earlier]).any(axis=1)]
            alive, matches = survivors(sig[others], sig[x], limits)
            xs.append(np.full(len(alive), x))
            ys.append(others[alive])
            score.append(matches)
        none = np.zeros(0, np.int64)
        order = np.argsort(-np.concatenate([none, *score]), kind="stable")
        links = []
        for x, y in zip(np.concatenate([none, *xs])[order].tolist(), np.concatenate([none, *ys])[order].tolist(), strict=True):
            if (rx := find(x)) != (ry := find(y)) and linked(sets[x], sets[y], percent):
                root[rx] = ry
                links.append((nodes[x], nodes[y]))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return work


def find_components(docs: DataFrame, nodes: DataFrame, percent: int, k: int, block: int) -> DataFrame:
    """(node, root) as components() gives it, for the confirmed links. docs: doc_id, text; nodes: node, nd_doc and nd_row (of a row that has its set), nd_n, nd_bands, nd_sig."""
    spark = docs.sparkSession
    n = partitions(spark)
    by_merge = lambda df: df.hint("merge")  # noqa: E731  one plan at every size
    # members in a random order that differs by band, so that blocks of different bands overlap
    flat = nodes.select(F.explode("nd_bands").alias("key"), "node", "nd_n").repartition(n, "key").sortWithinPartitions("key", F.xxhash64("key", "node"), "node")
    candidates = materialize(flat.mapInArrow(lambda batches: bucket_candidates(batches, block), CANDIDATES))
    pairs = candidates.where(F.col("b").isNotNull()).select("a", "b").distinct()
    members = candidates.where(F.col("b").isNull()).select("key", F.col("a").alias("node"), "block")
    signed = nodes.select("node", "nd_sig")
    pairs = pairs.join(by_merge(signed.toDF("a", "sig_a")), "a").join(by_merge(signed.toDF("b", "sig_b")), "b")
    limits = least_matches(percent)

    def alive():
        def work(batch: pa.RecordBatch) -> dict:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(batch.num_rows, SIGNATURE) for c in ("sig_a", "sig_b"))
            ok = np.zeros(batch.num_rows, bool)
            ok[survivors(a, b, limits)[0]] = True
            return {"ok": ok}

        return work

    ok = [T.StructField("ok", T.BooleanType())]
    pairs = materialize(append_columns(pairs.withColumn("text", F.lit("")), alive, ok, keep=["a", "b"]).where("ok").select("a", "b"))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    wanted = materialize(wanted.join(by_merge(nodes.select("node", "nd_doc", "nd_row")), "node"))
    texts = docs.select(F.col("doc_id").alias("nd_doc"), "text").withColumn("nd_row", F.xxhash64("text"))
    texts = materialize(wanted.join(by_merge(texts), ["nd_doc", "nd_row"]).dropDuplicates(["node"]).select("node", "text"))  # repeated rows are alike
    both = pairs.toDF("u", "v").join(by_merge(texts.toDF("u", "text")), "u").join(by_merge(texts.toDF("v", "text_v")), "v")
    links = append_columns(both, confirm_pairs(percent, k), ok, keep=["u", "v"], limit=1 << 20).where("ok").select("u", "v")
    # larger buckets: the pairs of each block, then those of different blocks that are not connected by now
    blocks = materialize(members.groupBy("key").agg(F.max("block").alias("last")))
    members = members.join(blocks, "key")
    signs = by_merge(nodes.select("node", F.col("nd_sig").alias("sig"), F.col("nd_bands").alias("bands")))
    no = F.lit(False)
    own = members.select("*", F.col("node").alias("root"), no.alias("stray"), no.alias("left")).join(signs, "node").join(by_merge(texts), "node")
    own = own.groupBy("key", "block").applyInArrow(join_members(percent, k, across=False), "u long, v long")
    roots = materialize(components(links.unionByName(own)))
    rest = members.where("last > 0").join(by_merge(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rest.groupBy("key", "root").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    rest = rest.join(apart, "key").join(by_merge(nodes.select("node", "nd_n")), "node")
    rest = materialize(rest.select("key", "node", "block", "last", "root", (F.col("root") != F.col("main")).alias("stray"), "nd_n"))
    if rest.isEmpty():
        return roots
    # strays are those outside their bucket's largest component; only they are compared with the other blocks
    cuts = F.ceil(F.greatest(F.count("*") / block, F.sum("nd_n") / BLOCK_SHINGLES)).cast("int")
    rest = rest.join(rest.where("stray").groupBy("key").agg(cuts.alias("cuts")), "key").join(signs, "node").join(by_merge(texts), "node")
    own_cut = F.pmod(F.xxhash64("node"), "cuts").cast("int")
    as_stray = F.transform(F.sequence(F.lit(0), "last"), lambda j: F.struct(own_cut.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))
    rest = rest.withColumn("at", F.explode(F.when(F.col("stray"), F.concat(as_stray, as_other)).otherwise(as_other)))
    rest = rest.select("key", "node", "block", "last", "root", "stray", "at.left", "at.i", "at.j", "sig", "bands", "text")
    more = rest.groupBy("key", "i", "j").applyInArrow(join_members(percent, k, across=True), "u long, v long")
    return materialize(components(roots.toDF("u", "v").unionByName(more)))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, block: int = BLOCK, keep_row: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, nd_n (size of its shingle set), nd_component (the least doc_id reachable by links), nd_kept.

    Texts are linked if their sets of k-word shingles (A-Z lower-cased; a text of fewer words is one shingle) share at
    least percent of their union. Null and empty texts and those without words are linked with nothing. Rows with a
    null doc_id are linked with nothing, too, have a null component and are kept. Rows that repeat a doc_id are judged by
    their own texts: each set of shingles is a node of its own, and doc_ids only name components. Very long texts are
    hashed whole, about 50 bytes of memory for each of theirs. An empty table gives no rows.

    nd_kept holds for the rows whose doc_id names their component. With keep_row there are nd_row (xxhash64 of the text)
    and nd_first, which holds for the rows of one (doc_id, text) of each component only, and for rows linked with nothing.

    Equal sets are one node before anything else, so copies cost no pairs. A bucket of many texts that aren't equal is
    cut into blocks of at most block members, each of which returns a spanning forest, not all pairs. Then those outside
    the largest component of a bucket are compared with its other blocks, so that no link is missed; what is connected
    already is neither sent nor compared again.
    """
    base = append_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("nd_row")), sign(percent, k), BASE, keep=["doc_id", "nd_row"], limit=1 << 20)
    base = materialize(base)
    some = base.where(F.col("nd_set").isNotNull() & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "nd_row"))
    nodes = some.groupBy("nd_set").agg(first.alias("m"), F.first("nd_n").alias("nd_n"), F.first("nd_bands").alias("nd_bands"), F.first("nd_sig").alias("nd_sig"))
    # the numbers are unique in what is written, whatever a task that is run again had given
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "nd_set", F.col("m.doc_id").alias("nd_doc"), F.col("m.nd_row").alias("nd_row"), "nd_n", "nd_bands", "nd_sig"))
    roots = find_components(docs.select("doc_id", "text"), nodes, percent, k, block)
    rooted = materialize(nodes.select("nd_set", "node", "nd_doc", "nd_row").join(roots, "node", "left").select("nd_set", F.coalesce("root", "node").alias("root"), "nd_doc", "nd_row"))
    names = rooted.groupBy("root").agg(F.min(F.struct("nd_doc", "nd_row")).alias("nd_name"))
    named = materialize(rooted.join(names, "root").select("nd_set", "nd_name"))
    out = base.select("doc_id", "nd_row", "nd_n", "nd_set").join(named, "nd_set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("nd_name.nd_doc", "doc_id"))
    is_first = F.col("doc_id").isNull() | F.col("nd_name").isNull() | (F.struct(F.col("doc_id").alias("nd_doc"), "nd_row") == F.col("nd_name"))
    row = ["nd_row", is_first.alias("nd_first")] if keep_row else []
    return out.select("doc_id", *row, "nd_n", component.alias("nd_component"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("nd_kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 % of five-word shingles."""
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("nd_n").alias("n_shingles"), F.col("nd_component").alias("component_id"), F.col("nd_kept").alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.y, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""
