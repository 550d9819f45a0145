"""What the operators share: scratch tables, whole-text chunks for numpy, hashes of words and shingles."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellex.sources import spread
from tessellex.sources.scratch import materialize, scratch, scratch_dir

__all__ = ["materialize", "scratch", "scratch_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids that are null sort after every other id.
NO_ID = 2**63 - 1
#: Bytes of text that numpy handles at once; a longer text is a chunk of its own.
CHUNK = 2 << 20


# --- tables ---------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in as many partitions as there are cores, where a few files would be fewer tasks than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same where all is ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def any_names(prefix: str, *own: str) -> Callable[[Callable], Callable]:
    """For an operator on docs whose keep may name columns that it makes or reads itself (those of prefix, and own): they travel in one struct.

    They come back in their place under their names, also where a column of the result has the same one.
    """

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def called(docs: DataFrame, *args, keep=None, **options) -> DataFrame:
            if keep is None or not any(c.lower().startswith(prefix) or c.lower() in own for c in keep):
                return operator(docs, *args, **({} if keep is None else {"keep": keep}), **options)
            held = f"{prefix}kept"
            packed = docs.select(*[c for c in ("doc_id", "text", "source") if c in docs.columns], F.struct(*[F.col(f"`{c}`") for c in keep]).alias(held))
            out = operator(packed, *args, keep=type(keep)([held]), **options)
            names = [x for c in out.columns for x in ([F.col(f"{held}.`{k}`").alias(k) for k in keep] if c == held else [F.col(c)])]
            return out.select(*names)

        return called

    return around


# --- Arrow and numpy ------------------------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of text at most, rows whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        sizes = np.frombuffer(sizes.buffers()[1], np.int32 if pa.types.is_string(sizes.type) else np.int64)[sizes.offset : sizes.offset + batch.num_rows + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], fields: list[T.StructField], keep: list[str] | None = None, limit: int = CHUNK) -> DataFrame:
    """mapInArrow over df: the columns keep (all where None), then fields, which make()(chunk) returns by name.

    make runs once a task, so tables of the task are built there.
    """
    kept = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        work = make()
        for batch in chunks(batches, limit=limit):
            made = work(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays(
                [(c if isinstance(c, pa.Array) else pa.array(c, type=f.type)).cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out
            )

    return df.mapInArrow(run, schema)


class Bytes:
    """The texts of a chunk as one byte array, with a newline after each; starts and ends by text."""

    def __init__(self, texts: pa.Array) -> None:
        parts = texts.fill_null("").cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
        self.data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.ends = self.starts + sizes


def fold_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    """True for bytes of words: all but space and 09 to 0D."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64, a published constant set)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as the longest chunk so far."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK + 4096)
            up, down = np.full(size, self.BASE, np.uint64), np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


class Shingler:
    """Hashes of the k-word shingles of each text of a chunk, by whole words of bytes other than space and 09-0D, A-Z lower-cased.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """

    def __init__(self, k: int = 5) -> None:
        self.k, self.powers, self.fold, self.word = k, Powers(), fold_table(), space_table()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): text i has hashes[bounds[i]:bounds[i + 1]], in order and with repeats."""
        b = Bytes(texts)
        data = self.fold[b.data]
        inside = np.concatenate(([False], self.word[data]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])  # the newline at the end closes the last word
        first, last = edge[::2], edge[1::2]
        up, down = self.powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)))
        words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        at = np.searchsorted(first, np.append(b.starts, len(data)))  # words of text i: at[i] to at[i + 1]
        count = np.diff(at)
        whole = np.maximum(count - self.k + 1, 0)
        rolled = np.zeros(max(0, len(words) - self.k + 1), np.uint64)
        for j in range(self.k):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(rolled)]
        own = np.zeros(len(words) + 1, np.int64)
        np.add.at(own, at[:-1][whole > 0], 1)
        np.add.at(own, (at[:-1] + whole)[whole > 0], -1)
        picked = mix(rolled[np.flatnonzero(np.cumsum(own)[: len(rolled)])])
        short = np.flatnonzero((count > 0) & (whole == 0))
        bounds = np.concatenate(([0], np.cumsum(whole + ((count > 0) & (whole == 0)))))
        if not len(short):
            return picked, bounds
        out = np.empty(bounds[-1], np.uint64)
        hole = np.zeros(bounds[-1], bool)
        hole[bounds[short]] = True
        out[~hole] = picked
        with np.errstate(over="ignore"):
            for i in short:
                h = np.uint64(count[i])
                for w in words[at[i] : at[i + 1]]:
                    h = h * np.uint64(0xA0761D6478BD642F) + w
                out[bounds[i]] = mix(np.array([h]))[0]
        return out, bounds
