"""Embedding whitening: exact sums, a QR of each partition's centred rows, R factors merged in a tree, the SVD of the last."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import finite, matrix

#: Entries count in 64ths, moved by SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Factors that one task merges.
FAN = 16
#: Rows that are factored at once.
ROWS = 4096
#: Larger entries have no exact place in 64ths.
LARGEST = 2.0**46

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def gridded(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of each entry."""
    c = matrix(column, width)
    if c.size and np.abs(c).max() > LARGEST:
        raise ValueError(f"an entry above {LARGEST:g} has no exact place in {GRID}ths")
    return np.floor(GRID * c).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Mean:
    """n vectors and their sums by dimension; whole is the mean rounded down, rest what n * whole lacks of the sum."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Mean:
        return Mean(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        near = x - self.whole
        if near.size and (int(np.abs(near).max()) + 1) * self.n >= 1 << 63:
            return near.astype(object) * self.n - self.rest.astype(object)
        return near * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return self.deviations(x).astype(np.float64) / self.n


def squares(deviations: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact; one beyond 64 bits is an error."""
    largest = int(np.abs(deviations).max()) if deviations.size else 0
    if deviations.dtype != object and largest**2 * max(1, deviations.shape[1]) < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviations]
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a deviation takes more than 64 bits")
    return exact


def exact_sums(vectors: DataFrame) -> Mean | None:
    """n and the sums by dimension as integers: one row a task and dimension is summed by Spark. None without vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = gridded(batch.column(1), None if sums is None else len(sums))
                part = [int(v) for v in (x >> 20).sum(axis=0)], [int(v) for v in (x & 0xFFFFF).sum(axis=0)]  # neither overflows
                part = [(a << 20) + b for a, b in zip(*part, strict=True)]
                n, sums = n + batch.num_rows, part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            d = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["dim", "n", "s"])

    sums = vectors.mapInArrow(partial, "dim int, n long, s decimal(38,0)")
    rows = sorted(sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())  # one row a dimension
    if not rows:
        return None
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of several lengths in one table")
    return Mean.of(rows[0].n, [int(r.s) for r in rows])


def reduced(parts: list[np.ndarray]) -> np.ndarray:
    """The R factor of all parts' rows together."""
    return np.linalg.qr(np.vstack(parts), mode="r")


def factor(vectors: DataFrame, mean: Mean) -> np.ndarray:
    """R of the centred rows of all vectors: R'R is n times their covariance, which isn't formed.

    Each partition's rows are reduced as they come, so a task holds ROWS rows and one factor; factors are merged FAN at a time,
    by partition, in as many rounds as it takes. Only the last one, of dimensions squared, comes to the driver.
    """
    d = len(mean.whole)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                r = reduced([r, mean.centred(gridded(batch.column(1).slice(at, ROWS), d))])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        r = reduced([np.frombuffer(b, np.float64).reshape(-1, d) for b in group.column("r").to_pylist()])
        return pa.table([pa.array([group.column("part")[0].as_py() // FAN], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    factors = materialize(vectors.mapInArrow(local, "part int, r binary"))
    last = factors.agg(F.max("part")).first()[0]
    while last > 0:
        factors = factors.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merged, "part int, r binary")
        last //= FAN
    return np.frombuffer(factors.first().r, np.float64).reshape(-1, d)


def axes(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns), their eigenvalues, falling, and the trace of the covariance, from the SVD of R.

    Directions in which the vectors don't vary, to double precision, are left out: they can't be whitened. An eigenvector's
    largest entry is positive.
    """
    _, s, vt = np.linalg.svd(r)
    values = s * s / n
    k = int((s > s[0] * 8 * np.finfo(float).eps * max(r.shape)).sum()) if len(s) and s[0] > 0 else 0
    v = vt[: min(k, components)].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v, values[: v.shape[1]], float(values.sum())


def largest_error(vectors: DataFrame, mean: Mean, project: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; a matrix a task is summed by Spark."""
    d, k = project.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = mean.centred(gridded(batch.column(1), d)) @ project
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = vectors.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # components squared
    total = np.zeros(k * k)
    for r in cells:
        total[r.cell] = r.v
    return float(np.abs(total.reshape(k, k) / mean.n - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    A vector that is null, or holds null or non-finite entries, is dropped; the others are put on a grid of 64ths, moved by a
    million, centred by their exact mean and projected on the unit eigenvectors of their covariance (divisor n), over the
    root of the eigenvalue. deviation is the sum of (n * x - S)**2 in integers; explained is the eigenvalue's share of the trace;
    identity_error is one value, of the whitened rows. Repeated rows and ids count as often as they come, a null id stays
    null. Components in which nothing varies are left out, so one vector, or equal vectors only, give no rows, as an empty
    table does. Vectors of several lengths, entries above 2**46 and deviations above 64 bits are errors. Other columns
    don't matter.

    Four scans of the vectors; what travels are sums, factors and matrices of the dimensions, one a task.
    """
    spark = df.sparkSession
    vectors = finite(df, vector).select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    nothing = spark.createDataFrame([], OUT)
    mean = exact_sums(vectors)
    if mean is None:
        return nothing
    v, values, trace = axes(factor(vectors, mean), mean.n, components)
    d, k = v.shape
    if not k:
        return nothing
    project = v / np.sqrt(values)
    error, shares = largest_error(vectors, mean, project), values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                away = mean.deviations(gridded(part.column(1), d))
                white = (away.astype(np.float64) / mean.n) @ project
                m = part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, mean.n, np.int64)), pa.array(squares(away), pa.int64()).take(each),
                    pa.array(white.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 32 components; nulls, repeated rows and constant entries are handled as whiten says."""
    return whiten(table(spark, sf_dir, "embeddings"))
