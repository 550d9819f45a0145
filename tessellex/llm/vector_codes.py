"""Vector code compression: k-means of vector parts by heaps of slack, of which only violated parts are popped and scanned again."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.sources.scratch import release

from .common import materialize, table
from .vectors import finite, matrix

#: Entries count in 4096ths.
GRID = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors of a block, whose heaps are one row; places in a heap have PLACE bits.
BLOCK, PLACE = 4096, 16
#: Bounds are kept in 1024ths, rounded so that they stay bounds.
FINE = 1024
#: Entries up to here, as integers, have distances that fit 62 bits.
LARGEST = 1 << 27

STATE = "vc_ids array<long>, vc_labels array<int>, vc_data binary, vc_codes binary, vc_heaps array<binary>, vc_sums array<long>, vc_scanned long"
CODED = "vec_id long, vc_label int, vc_code string, vc_error long"


@dataclass(frozen=True)
class Books:
    """The codebooks (parts x entries x length) after some rounds, and by how much, in FINE, each entry's bounds have drifted so far."""

    entries: np.ndarray
    drifted: np.ndarray

    def moved_to(self, entries: np.ndarray) -> Books:
        """A part's upper bound grows by its own entry's way, its lower bound falls by the longest way of the other entries."""
        way = np.sqrt(((entries - self.entries) ** 2).sum(axis=2).astype(np.float64))
        others = np.stack([np.delete(way, e, axis=1).max(axis=1, initial=0.0) for e in range(way.shape[1])], axis=1)
        both = way + others
        return Books(entries, self.drifted + np.where(both > 0, np.ceil(both * FINE).astype(np.int64) + 1, 0))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the nearest entry, the first of equals, and the slack in FINE: by how much the second is farther, rounded down."""
    far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    nearest = far.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(far[rows, nearest].astype(np.float64))
    if far.shape[1] == 1:
        return nearest, np.full(len(x), LARGEST * FINE, np.int64)  # nothing to go to
    far[rows, nearest] = np.iinfo(np.int64).max
    return nearest, np.floor((np.sqrt(far.min(axis=1).astype(np.float64)) - upper) * FINE).astype(np.int64) - 1


class Block:
    """Some vectors, their codes, a heap for each part position and entry, and sums and counts of each entry's parts.

    A heap's items are slack plus the entry's drift when it was pushed, above the part's place in PLACE bits: while the item is
    above the entry's drift, no other entry can be as near.
    """

    def __init__(self, x: np.ndarray, books: Books) -> None:
        self.x, self.k, self.length = x, books.entries.shape[1], books.entries.shape[2]
        self.codes = np.zeros((len(x), PARTS), np.uint8)
        self.heaps: list[np.ndarray | list[int]] = []
        self.sums = np.zeros((PARTS, self.k, self.length + 1), np.int64)

    def part(self, p: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.x[rows, p * self.length : (p + 1) * self.length]

    def begin(self, books: Books) -> int:
        """All parts are scanned, and the heaps are built."""
        for p in range(PARTS):
            code, slack = scan(self.part(p), books.entries[p])
            self.codes[:, p] = code
            self.add(p, code, np.arange(len(self.x)), 1)
            for e in range(self.k):
                own = np.flatnonzero(code == e)
                heap = (((slack[own] + books.drifted[p, e]) << PLACE) | own).tolist()
                heapq.heapify(heap)
                self.heaps.append(heap)
        return PARTS * len(self.x)

    def add(self, p: int, code: np.ndarray, rows: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[p, :, :-1], code, sign * self.part(p, rows))
        np.add.at(self.sums[p, :, -1], code, sign)

    def advance(self, books: Books) -> int:
        """Pops what drift has violated, and scans it again; returns how many parts that were."""
        total = 0
        for p in range(PARTS):
            popped = []
            for e in range(self.k):
                limit = int(books.drifted[p, e] + 1) << PLACE  # items below it have no slack left
                heap = self.heaps[p * self.k + e]
                if len(heap) and heap[0] < limit:
                    heap = self.heap(p, e)
                    while heap and heap[0] < limit:
                        popped.append(heapq.heappop(heap) & ((1 << PLACE) - 1))
            if not popped:
                continue
            rows = np.array(popped)
            code, slack = scan(self.part(p, rows), books.entries[p])
            left = self.codes[rows, p] != code
            self.add(p, self.codes[rows[left], p], rows[left], -1)
            self.add(p, code[left], rows[left], 1)
            self.codes[rows, p] = code
            for e, item in zip(code.tolist(), (((slack + books.drifted[p, code]) << PLACE) | rows).tolist(), strict=True):
                heapq.heappush(self.heap(p, e), item)
            total += len(popped)
        return total

    def heap(self, p: int, e: int) -> list[int]:
        """The heap as a list, once it changes."""
        at = p * self.k + e
        if isinstance(self.heaps[at], np.ndarray):
            self.heaps[at] = self.heaps[at].tolist()
        return self.heaps[at]

    def errors(self, books: Books) -> np.ndarray:
        near = np.concatenate([books.entries[p][self.codes[:, p]] for p in range(PARTS)], axis=1)
        return ((self.x - near) ** 2).sum(axis=1)

    def columns(self, scanned: int) -> list[pa.Array]:
        heaps = [np.asarray(h, np.int64).tobytes() for h in self.heaps]
        return [pa.array([self.x.astype(np.int32).tobytes()], pa.binary()), pa.array([self.codes.tobytes()], pa.binary()), pa.array([heaps], pa.list_(pa.binary())), pa.array([self.sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())]

    @staticmethod
    def read(batch: pa.RecordBatch, i: int, books: Books) -> Block:
        k, length = books.entries.shape[1:]
        b = Block(np.frombuffer(batch.column(2)[i].as_py(), np.int32).reshape(-1, PARTS * length).astype(np.int64), books)
        b.codes = np.frombuffer(batch.column(3)[i].as_py(), np.uint8).reshape(-1, PARTS).copy()
        b.heaps = [np.frombuffer(h, np.int64) for h in batch.column(4)[i].as_py()]
        b.sums = np.array(batch.column(5)[i].as_py(), np.int64).reshape(PARTS, k, length + 1)
        return b


def whole(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(4096 * x) of each entry."""
    x = np.floor(GRID * matrix(column, width))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"an entry above {LARGEST // GRID} has squared distances beyond 64 bits")
    return x.astype(np.int64)


def fitted(vectors: DataFrame, first: Books) -> tuple[DataFrame, Books, list[int]]:
    """The blocks after all rounds and the last assignment, their codebooks, and how many parts each assignment scanned.

    Blocks stay where they are: a round reads a table of them and writes the next, and what travels are sums and counts
    by entry, one row a block and cell before Spark's partial sums. A lost executor costs its tasks of one round.
    """
    width = first.entries.shape[2] * PARTS

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                b = Block(whole(part.column(2), width), first)
                scanned = b.begin(first)
                kept = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept, *b.columns(scanned)], [c.split(" ")[0] for c in STATE.split(", ")])

    state, books, scans = materialize(vectors.mapInArrow(begin, STATE)), first, []
    for _ in range(ROUNDS):
        cells = state.select(F.posexplode("vc_sums").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v")).collect()  # parts x entries x (length + 1)
        scans.append(state.agg(F.sum("vc_scanned")).first()[0])
        sums = np.array([r.v for r in sorted(cells)], np.int64).reshape(*books.entries.shape[:2], -1)
        n = sums[:, :, -1:]
        books = books.moved_to(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books.entries))
        old, state = state, materialize(state.mapInArrow(advanced(books), STATE))
        release(old)
    return state, books, [*scans, state.agg(F.sum("vc_scanned")).first()[0]]


def advanced(books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read(batch, i, books)
                scanned = b.advance(books)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *b.columns(scanned)], batch.schema.names)

    return run


def coded(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, vc_label, vc_code, vc_error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.read(batch, i, books)
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([row.tobytes().hex() for row in b.codes]), pa.array(b.errors(books))], ["vec_id", "vc_label", "vc_code", "vc_error"])

    return state.mapInArrow(run, CODED)


def compress(df: DataFrame, vector: str = "embedding", id_: str = "vec_id", label: str = "label") -> tuple[DataFrame, Books | None, list[int]]:
    """Codes of all vectors, the codebooks (None without vectors), and the parts that were scanned by assignment.

    Vectors that are null, or hold null or non-finite entries, are dropped. Entries become floor(4096 * x); vectors are cut into
    eight parts, whose codebooks begin as those of the 16 smallest ids, ascending: null ids come last, equal ones by their
    vectors. With fewer than 16 vectors the books have fewer entries. Six rounds assign (ties to the lower index) and move each entry to its parts'
    mean, rounded down; an entry without parts stays. Repeated rows count as often as they come; an empty table gives no
    rows. Vectors of several lengths, of a length that isn't a multiple of 8, and entries above 2**15 are errors.
    """
    spark = df.sparkSession
    vectors = finite(df, vector).select(F.col(id_).cast("long").alias("vec_id"), F.col(label).cast("int").alias("vc_label"), F.col(vector).cast("array<double>").alias("v"))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()  # the first codebook
    if not start:
        return spark.createDataFrame([], CODED), None, []
    x = whole(pa.array([r.v for r in start], pa.list_(pa.float64())))
    if not x.shape[1] or x.shape[1] % PARTS:
        raise ValueError(f"vectors of {x.shape[1]} entries have no {PARTS} equal parts")
    entries = np.stack(np.split(x, PARTS, axis=1))
    state, books, scans = fitted(vectors, Books(entries, np.zeros(entries.shape[:2], np.int64)))
    return coded(state, books), books, scans


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 8 books of 16 entries, 6 rounds; nulls, ties and repeated rows are handled as compress says. Null labels are one label."""
    codes, books, _ = compress(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes)
    by_label = materialize(codes.groupBy(F.col("vc_label").alias("vc_of")).agg(F.sum("vc_error").alias("vc_sum")))
    both = codes.join(by_label, F.col("vc_label").eqNullSafe(F.col("vc_of")))
    return both.select("vec_id", F.col("vc_code").alias("code"), F.col("vc_error").alias("error"), F.col("vc_sum").alias("label_error"), F.lit(digest(books) if books else "").alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds, each scanning all parts."""
    parts = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"part AS MATERIALIZED (SELECT i, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"c0 AS (SELECT p, i - 1 AS e, v AS c FROM part WHERE i <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        square = "list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, part.p, any_value(v) AS v, min(struct_pack(d := {square}, e := e)) AS m FROM part JOIN c{r} ON c{r}.p = part.p GROUP BY i, part.p)")
        if r < ROUNDS:
            sums = f"SELECT p, m.e AS e, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY p, m.e, j"
            parts.append(f"n{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY j) AS c FROM ({sums}) GROUP BY p, e)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n ON n.p = o.p AND n.e = o.e)")
    return f"""WITH {', '.join(parts)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM c{ROUNDS}),
coded AS (SELECT i, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept ON kept.i = coded.i, books"""


SQL = _sql()
