"""Token alignment of raw and normalised texts and the edit distance over it (ANLD)."""

from __future__ import annotations

import difflib
import functools
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def aligned(a: list[str], b: list[str], padded: bool) -> Iterator[tuple[str, int, str, str | None]]:
    """(operation, position, source, target) of each source token; inserted targets have no source and are left out.

    padded: the published package's form, in which popular tokens of long texts are no anchors and what is left over of
    a replaced block maps to nothing. Else a replaced block is cut to its shorter side.
    """
    if a == b:
        yield from (("equal", i, x, x) for i, x in enumerate(a))
        return
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=padded).get_opcodes():
        for k in range(i2 - i1):
            if tag == "delete":
                yield tag, i1 + k, a[i1 + k], ""
            elif j1 + k < j2:
                yield tag, i1 + k, a[i1 + k], b[j1 + k]
            elif padded:
                yield tag, i1 + k, a[i1 + k], ""


#: From so many tokens of the target difflib leaves popular ones out; below, both forms have the same blocks.
JUNK = 200
#: Documents of fewer tokens are searched without bounds, and ranges of fewer are looked through before bounds are asked.
SHORT, NARROW = 48, 64

#: Pairs of equal tokens that are looked at one by one.
FEW = 20_000
FACTOR = 0x9E3779B97F4A7C15

Blocks = list[tuple[int, int, int]]


class Sides:
    """The tokens of both sides of a document, as numbers, with polynomial hashes of their prefixes; codes are the numbers' random 64 bits.

    Equal runs have equal hashes, so a collision can raise a bound, or lead to a match that isn't one, which is compared token by token.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> None:
        self.a, self.b, self.codes = a, b, codes
        self.x, self.y = a.tolist(), b.tolist()

    @functools.cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        power, back = (np.cumprod(np.full(max(len(self.a), len(self.b)), f, np.uint64)) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        ha, hb = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes[v] * power[: len(v)]))) for v in (self.a, self.b))
        return ha, hb, back

    @functools.cached_property
    def places(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for j, v in enumerate(self.y):
            found.setdefault(v, []).append(j)
        return found

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
        """difflib's longest match of two ranges: the first in a of the longest ones, then the first in b. It is known that none is longer than most."""
        x, places, most = self.x, self.places, min(most, ahi - alo, bhi - blo)
        besti, bestj, best, before, looked = alo, blo, 0, {}, 0
        for i in range(alo, ahi):
            now = {}
            of = places.get(x[i], ())
            for at in range(bisect_left(of, blo), len(of)):
                if (j := of[at]) >= bhi:
                    break
                k = now[j] = before.get(j - 1, 0) + 1
                if k > best:
                    besti, bestj, best = i - k + 1, j - k + 1, k
                    if k == most:
                        return besti, bestj, k
            before = now
            looked += len(now)
            if looked > FEW:
                i, j, k = self.sought(alo, ahi, blo, bhi, best, most)
                if self.x[i : i + k] == self.y[j : j + k]:
                    return i, j, k
                looked = -(1 << 60)
        return besti, bestj, best

    def sought(self, alo: int, ahi: int, blo: int, bhi: int, low: int, high: int) -> tuple[int, int, int]:
        """longest() of ranges whose longest match has from low to high tokens, 1 at least, by halving the length of runs that both have."""
        ha, hb, back = self.hashes
        low, k, found = low - 1, high, (alo, blo, 0)
        while low < high:
            wa, wb = ((h[lo + k : hi + 1] - h[lo : hi + 1 - k]) * back[lo : hi + 1 - k] for h, lo, hi in ((ha, alo, ahi), (hb, blo, bhi)))
            order = np.argsort(wb, kind="stable")
            at = np.searchsorted(wb, wa, sorter=order)
            hit = wb[order[np.minimum(at, len(wb) - 1)]] == wa
            if hit.any():
                i = int(hit.argmax())
                low, found = k, (alo + i, blo + int(order[at[i]]), k)
                k = (low + high + 1) // 2
            else:
                high = k - 1
                # most are little longer than what is known
                k = min((low + high + 1) // 2, max(low + 1, 2 * low))
        return found

    def blocks(self, alo: int, ahi: int, blo: int, bhi: int) -> Blocks:
        """difflib's matching blocks of two ranges, in order. What is left of a match has none as long, what is right of it none that is longer."""
        found, open_ = [], [(alo, ahi, blo, bhi, ahi - alo)]
        while open_:
            alo, ahi, blo, bhi, most = open_.pop()
            if alo < ahi and blo < bhi and most:
                i, j, k = self.longest(alo, ahi, blo, bhi, most)
                if k:
                    found.append((i, j, k))
                    open_ += [(alo, i, blo, j, k - 1), (i + k, ahi, j + k, bhi, k)]
        return sorted(found)

    def elsewhere(self) -> np.ndarray:
        """For each position of a, no less than the length of the longest match that starts there and is not at the same position of b, which is as long."""
        n, (ha, hb, back) = len(self.a), self.hashes
        found = np.zeros(n, np.int64)
        sa = sb = np.arange(n)
        k = 1
        while len(sa) and len(sb):
            found[sa] = np.iinfo(np.int64).max
            ra, rb = sa[sa + k <= n], sb[sb + k <= n]
            found[sa[sa + k > n]] = k - 1
            wa, wb = (ha[ra + k] - ha[ra]) * back[ra], (hb[rb + k] - hb[rb]) * back[rb]
            of = np.unique(np.concatenate((wa, wb)), return_inverse=True)[1]
            ia, ib = of[: len(ra)], of[len(ra) :]
            same, ina, inb = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            ina[ra], inb[rb] = True, True
            both = np.flatnonzero(ina & inb)
            same[both] = ha[both + k] - ha[both] == hb[both + k] - hb[both]
            size = len(wa) + len(wb)
            sa, sb = ra[np.bincount(ib, minlength=size)[ia] > same[ra]], rb[np.bincount(ia, minlength=size)[ib] > same[rb]]
            gone = np.ones(n, bool)
            gone[sa] = False
            found[ra[gone[ra]]] = k - 1
            k = max(k + 1, k * 7 // 5)
        return found


def askew(sides: Sides) -> list[tuple[int, int, Blocks]]:
    """The ranges, the same of a and b, in which difflib's blocks leave the diagonal, and the blocks there; a and b are of one length.

    A range's longest run of equal tokens at equal positions is its longest match where no other match in it can be as long. Such a run
    is taken out as difflib does, without a search; only ranges where bounds don't tell are searched.
    """
    a, b, x, y, n = sides.a, sides.b, sides.x, sides.y, len(sides.a)
    equal = np.concatenate(([False], a == b, [False]))
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    total = np.concatenate(([0], np.cumsum(equal[1:-1]))).tolist()
    bound = sides.elsewhere() if n > SHORT else None
    found, open_ = [], [(0, n, 0, len(starts))]
    while open_:
        lo, hi, p, q = open_.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= NARROW and len({*x[lo:hi], *y[lo:hi]}) == 2 * (hi - lo) - total[hi] + total[lo]:
            continue  # no token of one side is elsewhere on the other
        if bound is not None:
            most = bound[lo:hi].max()
            if not most:
                continue
            if p < q:
                r = p + int(lengths[p:q].argmax())
                if most < lengths[r]:
                    i, k = int(starts[r]), int(lengths[r])
                    open_ += [(lo, i, p, r), (i + k, hi, r + 1, q)]
                    continue
        i, j, k = sides.longest(lo, hi, lo, hi, hi - lo)
        if k and i == j:
            r = int(np.searchsorted(starts, i))
            open_ += [(lo, i, p, r), (i + k, hi, r + 1, q)]
        elif k:
            found.append((lo, hi, sorted([(i, j, k), *sides.blocks(lo, i, lo, j), *sides.blocks(i + k, hi, j + k, hi)])))
    return found


EQUAL, REPLACE, DELETE = range(3)
OPERATIONS = ["equal", "replace", "delete"]


def mapped(a: np.ndarray, b: np.ndarray, padded: bool, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a, what aligned() has of it: its target's position in b, -1 if it maps to nothing, -2 if it is left out, and the operation.

    Tokens are numbers, and codes their random 64 bits.
    """
    target, op = np.full(len(a), -2), np.full(len(a), EQUAL)
    if len(a) == len(b) and (not padded or len(b) < JUNK or np.array_equal(a, b)):
        target = np.arange(len(a))
        op[a != b] = REPLACE
        parts = askew(Sides(a, b, codes)) if op.any() else []
    elif padded and len(b) >= JUNK:
        matcher = difflib.SequenceMatcher(None, a.tolist(), b.tolist())
        parts = [(0, len(a), matcher.get_matching_blocks()[:-1])]
    else:
        parts = [(0, len(a), Sides(a, b, codes).blocks(0, len(a), 0, len(b)))]
    for lo, hi, matches in parts:
        i1, j1, end = lo, lo, len(b) if len(a) != len(b) else hi
        target[lo:hi] = -2
        for i2, j2, k in [*matches, (hi, end, 0)]:
            m = min(i2 - i1, j2 - j1)
            target[i1 : i1 + m] = np.arange(j1, j1 + m)
            op[i1:i2] = REPLACE if j1 < j2 else DELETE
            if padded or j1 == j2:
                target[i1 + m : i2] = -1
            target[i2 : i2 + k], op[i2 : i2 + k] = np.arange(j2, j2 + k), EQUAL
            i1, j1 = i2 + k, j2 + k
    return target, op


def first_batches(batch: pa.RecordBatch, schema: pa.Schema, n_keys: int, padded: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Of aligned()'s rows of a batch, the first of a source and its keys; where more than `most` would be held, some later ones too."""
    raw, norm = batch.column(1 + n_keys), batch.column(2 + n_keys)
    words = pa.chunked_array([raw.flatten(), norm.flatten()]).dictionary_encode("encode").unify_dictionaries().combine_chunks()
    numbers, names = words.indices.to_numpy(), words.dictionary
    sizes = [np.diff(c.offsets.to_numpy()) if not c.null_count else c.value_lengths().fill_null(0).to_numpy() for c in (raw, norm)]
    at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    codes = np.random.default_rng(0).integers(0, 1 << 64, len(names), np.uint64)
    ids = batch.column(0).to_numpy()
    keys = [batch.column(1 + j) for j in range(n_keys)]
    group = [tuple(k[i].as_py() for k in keys) for i in range(len(ids))]
    seen: dict[tuple, np.ndarray] = {}
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def given() -> pa.RecordBatch:
        doc, pos, op, src, dst = (np.concatenate(c) for c in zip(*held, strict=True))
        targets = pc.if_else(pa.array(dst < 0), "", names.take(pa.array(np.maximum(dst, 0))))
        cells = [pa.array(ids[doc]), *(k.take(pa.array(doc)) for k in keys), pa.array(pos), pa.array(OPERATIONS).take(pa.array(op)), names.take(pa.array(src)), targets]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    for i in np.argsort(ids, kind="stable").tolist():
        a, b = (numbers[at[o] : at[o + 1]] for o in (i, len(ids) + i))
        target, op = mapped(a, b, padded, codes)
        if group[i] not in seen:
            seen[group[i]] = np.zeros(len(names), bool)
        fresh = np.flatnonzero((target > -2) & ~seen[group[i]][a])
        fresh = fresh[np.sort(np.unique(a[fresh], return_index=True)[1])]
        while len(fresh):
            pos, fresh = fresh[: most - rows], fresh[most - rows :]
            t = target[pos]
            held.append((np.full(len(pos), i), pos, op[pos], a[pos], np.where(t < 0, -1, b[t] if len(b) else -1)))
            seen[group[i]][a[pos]] = True
            rows += len(pos)
            if rows >= most:
                yield given()
                held, rows = [], 0
    if rows:
        yield given()


#: Rows of tokens that a task holds at once.
ROWS = 20_000


def aligned_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, n_keys: int, padded: bool, first_only: bool, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """align() in a task: one document is in hand at a time (with first_only the tokens of a batch too, as numbers), and no more than `most` rows."""
    if first_only:
        for batch in batches:
            yield from first_batches(batch, schema, n_keys, padded, most)
        return

    def given(rows: Iterable[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        raw, norm = batch.column(1 + n_keys), batch.column(2 + n_keys)
        rows: list[tuple] = []
        for i in range(len(ids)):
            key = tuple(batch.column(1 + j)[i].as_py() for j in range(n_keys))
            for op, pos, s, t in aligned(raw[i].as_py(), norm[i].as_py(), padded):
                rows.append((ids[i], *key, pos, op, s, t))
                if len(rows) >= most:
                    yield given(rows)
                    rows = []
        if rows:
            yield given(rows)


def align(df: DataFrame, padded: bool = True, keys: tuple[str, ...] = (), first_only: bool = False) -> DataFrame:
    """doc_id, keys, pos, op, src, dst from doc_id, keys, raw, norm (arrays of tokens). One row a token; documents are aligned each for itself.

    With first_only, rows of a source and its keys that follow a row of a lesser (doc_id, pos) are mostly left out: what anld() needs, in rows
    by types and not by tokens.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[df.schema[k] for k in keys], *[T.StructField(n, T.LongType() if n == "pos" else T.StringType()) for n in ("pos", "op", "src", "dst")]])
    arrow, n = to_arrow_schema(schema), len(keys)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "raw", "norm").mapInArrow(lambda batches: aligned_batches(batches, arrow, n, padded, first_only), schema)


def word_distances(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, distance: of each distinct source the edit distance to its first target, by its length.

    pairs: keys, doc_id, pos, src, dst. The first target is that of the least (doc_id, pos).
    """
    first = pairs.where("src <> ''").groupBy(*keys, "src").agg(F.min(F.struct("doc_id", "pos", "dst")).alias("m"))
    return first.select(*keys, "src", (F.levenshtein("src", F.col("m.dst")) / F.char_length("src")).alias("distance"))


def anld(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, anld, n_types: the mean of word_distances()."""
    return word_distances(pairs, keys).groupBy(*keys).agg(F.avg("distance").alias("anld"), F.count("*").alias("n_types"))
