"""Suffix-array dedup: hash-compared suffix sort of blocks of the corpus.

Windows of LENGTH bytes that hold the same bytes have the same least K-gram at the same place, so that K-gram says in
which block a window is sorted. Neighbouring windows with one such K-gram travel as one segment, each once, packed and
compressed. A block sorts the suffixes at which windows may be repeated: common extensions come from prefix polynomial
hashes by binary search, a mergesort compares with them, and neighbours that seem equal are verified byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, Bytes, Powers, append_columns, chunks, mix, partitions, table

LENGTH, K = 50, 8
#: Bytes of text of a map step, and of a block; the windows of a block travel as about 3.3 times as many bytes.
STEP, BLOCK = 1 << 20, 3 << 19
#: Steps of a task whose segments for a bucket share a blob: larger blobs compress better.
JOINED = 16
#: Buckets among which one round deals, 48 GB of text. More of them take more rounds, so that blobs stay large at any size of the input.
FAN = 32_768
#: A task holds so many bytes of segments for each bucket before it writes their blobs, HELD in all at most.
BLOB, HELD = 8 << 10, 160 << 20
PLACE = np.uint64((1 << 24) - 1)


def rounds(blocks: int, fan: int) -> list[int]:
    """How many ways each round deals, so that there are blocks buckets or more in the end."""
    n = 1
    while fan**n < blocks:
        n += 1
    return [max(1, math.ceil(blocks ** (1 / n)))] * n


def ngrams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer, the first byte highest; past the end come zeros."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view(">u8")
        out[o::8] = part[: len(out[o::8])]
    return out[: len(data)]


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray, limit: int = 1 << 19) -> np.ndarray:
    """The concatenation of data[first[i]:first[i] + size[i]], in parts, so that places take little memory beside what they fetch."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    at = done = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        own, last = size[at:stop], int(ends[stop - 1])
        place = np.repeat(first[at:stop] - (ends[at:stop] - own - done), own)
        place += np.arange(last - done)
        out[done:last] = data[place]
        at, done = stop, last
    return out


def segments(data: np.ndarray, first: np.ndarray, last: np.ndarray, grams: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, key) of the runs of windows that share their least gram, in the texts data[first[i]:last[i]], fewer than 2**24 bytes in all.

    A gram is K bytes, or a multiple of that: longer ones deal out what holds a frequent short one.
    """
    span = LENGTH - K * grams + 1
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    h = part = mix(ngrams(data))
    for g in range(1, grams):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.concatenate((part[K * g :], np.zeros(min(K * g, len(part)), np.uint64))))
    value = np.full(-(-len(data) // span) * span, ~np.uint64(0))
    value[: len(data)] = h & ~PLACE | np.arange(len(data), dtype=np.uint64)
    rows = value.reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & PLACE).astype(np.int64)
    mark = np.zeros(len(data) + 1, np.int8)
    long = last - first >= LENGTH
    np.add.at(mark, first[long], 1)
    np.add.at(mark, last[long] - LENGTH + 1, -1)
    inside = np.cumsum(mark, dtype=np.int8)[:n].astype(bool)
    anchor[~inside] = -1
    turn = np.concatenate(([True], anchor[1:] != anchor[:-1], [True]))
    edges = np.flatnonzero(turn)
    begin, end = edges[:-1], edges[1:]
    real = anchor[begin] >= 0
    begin, end = begin[real], end[real]
    return begin, end - begin + LENGTH - 1, h[anchor[begin]]


class Hashes:
    """Prefix polynomial hashes of data: of(a, n) is the hash of the n bytes from a."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)))

    def of(self, a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a]


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a[i]:a[i] + size[i]] equals data[b[i]:...]."""
    if not len(a):
        return np.zeros(0, bool)
    same = gather(data, a, size) == gather(data, b, size)
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def classes(data: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each segment the number of the first segment, in the order given, with the same bytes. Equal hashes are verified."""
    code = mix(code + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(code, kind="stable")
    new = np.concatenate(([True], code[order][1:] != code[order][:-1]))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(first), np.int64)
    out[order] = head
    other = np.flatnonzero(out != np.arange(len(out)))
    alike = (size[other] == size[out[other]])
    check = other[alike]
    for i in range(0, len(check), 20_000):
        part = check[i : i + 20_000]
        alike[np.flatnonzero(alike)[i : i + 20_000]] = equal_bytes(data, first[part], first[out[part]], size[part])
    seen: dict[bytes, int] = {}
    for i in other[~alike].tolist():  # a collision of hashes
        out[i] = seen.setdefault(data[first[i] : first[i] + size[i]].tobytes(), i)
    return out


def pieces(data: np.ndarray, first: np.ndarray, size: np.ndarray, powers: Powers, limit: int = 1 << 20) -> Iterator[tuple]:
    """(numbers, hashes, first, size) of the segments by turns, their bytes copied together: hashes of a block take no more memory than of a piece."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit)))
        own = size[at:stop]
        yield np.arange(at, stop), Hashes(gather(data, first[at:stop], own), powers), np.cumsum(own) - own, own
        at = stop


# --- packing --------------------------------------------------------------------------------------


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress better; undone by cumsum."""
    return np.diff(x, prepend=x.dtype.type(0))


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    return zstandard.compress(head + b"".join(x.tobytes() for x in arrays), 6)


def unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


SEGMENTS = [np.uint8, np.uint8, np.int32, np.int64, np.int64, np.int64]  # bytes, sizes; of entries: segment and id (both as differences), row, start
SPANS = [np.int64, np.int64, np.int64, np.int64]  # id, row, start, end
PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])


class Packer:
    """Blobs of segments for each bucket, and of spans that are decided here.

    Of equal segments of a step, the document with the least id sends one copy; those of larger ids are repeats already.
    """

    def __init__(self, fan: int, grams: int) -> None:
        self.fan, self.grams, self.powers = fan, grams, Powers()
        self.held: dict[int, list[list[np.ndarray]]] = {}
        self.late: list[list[np.ndarray]] = []
        self.done = self.size = 0

    def flushed(self, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        """What is held, in record batches of about limit bytes; each part is let go as it is packed."""
        out, size = [], 0
        if self.late:
            out.append((int(self.late[0][0][0] % self.fan), 1, pack([np.concatenate([x[i] for x in self.late]) for i in range(4)])))
            self.late.clear()
        for bucket in sorted(self.held):
            parts = self.held.pop(bucket)
            shift = np.cumsum([0] + [len(x[1]) for x in parts])
            number = np.concatenate([x[2] + n for x, n in zip(parts, shift, strict=False)])
            data, size_, ids, rows, start = (np.concatenate([x[i] for x in parts]) for i in (0, 1, 3, 4, 5))
            out.append((bucket, 0, pack([data, size_, steps(number.astype(np.int32)), steps(ids), rows, start])))
            size += len(out[-1][2])
            if size > limit:
                yield self._batch(out)
                out, size = [], 0
        self.size = 0
        yield self._batch(out)

    @staticmethod
    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    def step(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, rows: np.ndarray, base: np.ndarray, within: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes the texts data[first[i]:last[i]] of (ids[i], rows[i]), which start at base[i] there; within are their buckets of the round before."""
        self._take(data, first, last, ids, rows, base, within)
        self.done += 1
        if self.done % JOINED == 0 and self.size >= min(HELD, BLOB * self.fan):
            yield from self.flushed()

    def _take(self, data, first, last, ids, rows, base, within) -> None:
        start, size, key = segments(data, first, last, self.grams)
        if not len(start):
            return
        text = np.searchsorted(first, start, side="right") - 1
        owner = ids[text]
        if (owner[1:] < owner[:-1]).any():
            order = np.argsort(owner, kind="stable")  # so that the first of equal segments has the least id
            start, size, key, text, owner = (x[order] for x in (start, size, key, text, owner))
        head = classes(data, start, size, Hashes(data, self.powers).of(start, size))
        where = base[text] + start - first[text]
        later = owner > owner[head]
        if later.any():
            t = text[later]
            self.late.append([ids[t], rows[t], where[later], where[later] + size[later]])
        bucket = within[text] * self.fan + (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.fan)).astype(np.int64)
        stay = np.flatnonzero(~later)
        stay = stay[np.lexsort((head[stay], bucket[stay]))]
        new = np.concatenate(([True], head[stay][1:] != head[stay][:-1]))
        distinct, number = head[stay][new], np.cumsum(new) - 1
        sent, length = gather(data, start[distinct], size[distinct]), size[distinct]
        ends = np.concatenate(([0], np.cumsum(length)))
        self.size += len(sent)
        b = bucket[stay]
        cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
        length, who, row, at = length.astype(np.uint8), ids[text[stay]], rows[text[stay]], where[stay]
        for a, z, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), b[cuts[:-1]].tolist(), strict=True):
            lo, hi = int(number[a]), int(number[z - 1]) + 1
            self.held.setdefault(k, []).append([sent[ends[lo] : ends[hi]], length[lo:hi], number[a:z] - lo, who[a:z], row[a:z], at[a:z]])


def pack_segments(fan: int):
    """For mapInArrow over (sd_id, sd_row, text): the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(fan, 1)
        for batch in chunks(batches, limit=STEP):
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            b = Bytes(batch.column(2))
            if len(b.data) <= 4 * STEP:
                pieces = [(b.data, b.starts, b.ends, np.zeros(len(ids), np.int64))]
            else:  # one long text: pieces that overlap by a window less a byte
                text = b.data[: int(b.ends[0])]
                pieces = ((p := text[at : at + STEP + LENGTH - 1], np.zeros(1, np.int64), np.array([len(p)]), np.array([at])) for at in range(0, len(text) - LENGTH + 1, STEP))
            for data, first, last, base in pieces:
                yield from packer.step(data, first, last, ids, rows, base, np.zeros(len(ids), np.int64))
        yield from packer.flushed()

    return run


def deal_again(fan: int, grams: int):
    """For mapInArrow over PACKED, blobs of one bucket together: a later round, in which the segments of a bucket are cut and dealt by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = Packer(fan, grams), [], 0
        for batch in batches:
            spans = np.array(batch.column(1).to_pylist(), np.int64) == 1
            if spans.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(spans)) for c in batch.columns], names=["bucket", "kind", "blob"])
            for i in np.flatnonzero(~spans).tolist():
                held.append((batch.column(0)[i].as_py(), *unpack(batch.column(2)[i].as_py(), SEGMENTS)))
                size += len(held[-1][1])
                if size > STEP:
                    for part in entries(held):
                        yield from packer.step(*part)
                    held, size = [], 0
        for part in entries(held):
            yield from packer.step(*part)
        yield from packer.flushed()

    return run


def entries(held: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """Unpacked blobs as arguments of Packer.step, about STEP bytes at a time: each entry is a text."""
    if not held:
        return
    size = np.concatenate([h[2] for h in held]).astype(np.int64)
    shift = np.cumsum([0] + [len(h[2]) for h in held])
    segment = np.concatenate([np.cumsum(h[3], dtype=np.int64) + s for h, s in zip(held, shift, strict=False)])
    data, begin = np.concatenate([h[1] for h in held]), np.cumsum(size) - size
    ids = np.concatenate([np.cumsum(h[4]) for h in held])
    rows, start = (np.concatenate([h[i] for h in held]) for i in (5, 6))
    within = np.repeat([h[0] for h in held], [len(h[3]) for h in held])
    ends, at = np.cumsum(size[segment]), 0
    while at < len(segment):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP)))
        own, n = segment[at:stop], size[segment[at:stop]]
        first = np.cumsum(n) - n
        yield gather(data, begin[own], n), first, first + n, ids[at:stop], rows[at:stop], start[at:stop], within[at:stop]
        at = stop


# --- sorting a block ------------------------------------------------------------------------------


def extension(hashes: Hashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common extension of the suffixes at a and b, LENGTH at most, by binary search with prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.of(a, mid) == hashes.of(b, mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(data: np.ndarray, at: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(at, common): the suffixes at `at` by their first LENGTH bytes, and the common extension of each with the one before.

    Runs come from the first 16 bytes; inside, a mergesort in which each element finds its rank in the sibling run by
    binary search, all runs at once.
    """
    grams = ngrams(data)
    at = at[np.lexsort((at, grams[at + 8], grams[at]))]
    new = np.concatenate(([True], (grams[at[1:]] != grams[at[:-1]]) | (grams[at[1:] + 8] != grams[at[:-1] + 8])))
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)[group]
    end = np.append(np.flatnonzero(new), len(at))[group + 1]
    place, width = np.arange(len(at)), 1
    while len(at) and width < int((end - begin).max()):
        active = np.flatnonzero(end - begin > width)
        r = place[active] - begin[active]
        left = r // width % 2 == 0
        low0 = begin[active] + (r // width + np.where(left, 1, -1)) * width
        low, high = np.minimum(low0, end[active]), np.minimum(low0 + width, end[active])
        base = low.copy()
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(at) - 1)
            x, y = at[active], at[mid]
            common = extension(hashes, x, y)
            tie = common == LENGTH
            edge = np.minimum(common, LENGTH - 1)
            below = np.where(tie, ~left, data[y + edge] < data[x + edge])  # equal ones of the left run come first
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        rank = begin[active] + r // (2 * width) * 2 * width + r % width + low - base
        merged = at.copy()
        merged[rank] = at[active]
        at, width = merged, width * 2
    common = np.zeros(len(at), np.int64)
    common[1:] = extension(hashes, at[1:], at[:-1])
    return at, common


def sort_block(blobs: list[bytes], powers: Powers) -> list[np.ndarray]:
    """Spans (id, row, start, end) of the entries' windows that are in an entry of a smaller id, from a block's packed segments."""
    parts = [unpack(b, SEGMENTS) for b in blobs]
    data = np.concatenate([*(p[0] for p in parts), np.zeros(LENGTH + 16, np.uint8)])
    size = np.concatenate([p[1] for p in parts]).astype(np.int64)
    first = np.cumsum(size) - size
    shift = np.cumsum([0] + [len(p[1]) for p in parts])
    segment = np.concatenate([np.cumsum(p[2], dtype=np.int64) + s for p, s in zip(parts, shift, strict=False)])
    ids = np.concatenate([np.cumsum(p[3]) for p in parts])
    rows, start = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
    owner = classes(data, first, size, np.concatenate([h.of(f, n) for _, h, f, n in pieces(data, first, size, powers)]))[segment]  # equal segments are one
    least = np.full(len(size), NO_ID, np.int64)
    np.minimum.at(least, owner, ids)
    heads = np.unique(owner)
    windows = size[heads] - LENGTH + 1
    # windows of different segments that may be equal: the rest needs no sort
    code = np.concatenate([h.of(gather(np.arange(f[-1] + n[-1]), f, n - LENGTH + 1), LENGTH) for _, h, f, n in pieces(data, first[heads], size[heads], powers)])
    order = np.argsort(code)
    again = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    del code
    suspect = np.zeros(len(order), bool)
    suspect[order[again]] = suspect[order[again + 1]] = True
    del order, again
    minimum = np.repeat(least[heads], windows)
    if suspect.any():
        begin = np.cumsum(windows) - windows
        some = np.flatnonzero(np.logical_or.reduceat(suspect, begin))  # only their bytes are needed from here
        near = np.concatenate((gather(data, first[heads[some]], size[heads[some]]), np.zeros(LENGTH + 16, np.uint8)))
        where = gather(np.arange(len(suspect)), begin[some], windows[some])
        at = gather(np.arange(len(near)), np.cumsum(size[heads[some]]) - size[heads[some]], windows[some])
        where, at = where[suspect[where]], at[suspect[where]]
        back = np.empty(len(near), np.int64)
        back[at] = where
        run, common = suffix_sort(near, at, Hashes(near, powers))
        same = common == LENGTH
        other = np.flatnonzero(same)
        verified = np.concatenate([np.ones(0, bool), *(equal_bytes(near, run[o], run[o - 1], np.full(len(o), LENGTH)) for o in (other[i : i + 20_000] for i in range(0, len(other), 20_000)))])
        if not verified.all():  # a collision of hashes: sort the bytes themselves
            run = np.array(sorted(run.tolist(), key=lambda p: near[p : p + LENGTH].tobytes()), np.int64)
            same = np.concatenate(([False], equal_bytes(near, run[1:], run[:-1], np.full(len(run) - 1, LENGTH))))
        low = np.minimum.reduceat(minimum[back[run]], np.flatnonzero(~same))
        minimum[back[run]] = low[np.cumsum(~same) - 1]
    # a window is repeated where the least id that has it is below the entry's
    offset = np.full(len(size), -1, np.int64)
    offset[heads] = np.cumsum(windows) - windows
    count = size[owner] - LENGTH + 1
    low, high = np.minimum.reduceat(minimum, offset[heads]), np.maximum.reduceat(minimum, offset[heads])
    of_head = np.searchsorted(heads, owner)
    every = np.flatnonzero(high[of_head] < ids)
    some = np.flatnonzero((low[of_head] < ids) & ~(high[of_head] < ids))
    out = [np.stack([ids[every], rows[every], start[every], start[every] + count[every] + LENGTH - 1])]
    if len(some):
        n = count[some]
        flag = gather(minimum, offset[owner[some]], n) < np.repeat(ids[some], n)
        entry, pos = np.repeat(some, n), gather(np.arange(int(n.max())), np.zeros(len(n), np.int64), n)
        turn = np.flatnonzero(np.concatenate(([True], (flag[1:] != flag[:-1]) | (entry[1:] != entry[:-1]), [True])))
        a, z = turn[:-1], turn[1:] - 1
        a, z = a[flag[a]], z[flag[a]]
        out.append(np.stack([ids[entry[a]], rows[entry[a]], start[entry[a]] + pos[a], start[entry[a]] + pos[z] + LENGTH]))
    return list(np.concatenate(out, axis=1))


def repeats_of_block(blobs: pa.Table) -> pa.Table:
    """For applyInArrow over a bucket."""
    kind = blobs.column("kind").to_pylist()
    rows = blobs.column("blob").to_pylist()
    made = [unpack(r, SPANS) for k, r in zip(kind, rows, strict=True) if k == 1]
    sent = [r for k, r in zip(kind, rows, strict=True) if k == 0]
    if sent:
        made.append(sort_block(sent, Powers()))
    columns = [np.concatenate([m[i] for m in made]).astype(np.int64) for i in range(4)]
    return pa.table(dict(zip(("sd_id", "sd_row", "sd_start", "sd_end"), columns, strict=True)))


RESULT = [T.StructField("sd_n_bytes", T.LongType()), T.StructField("sd_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("sd_kept", T.BinaryType())]


def squeeze(rows: pa.RecordBatch) -> dict:
    return {"sd_text": [None if t is None else zstandard.compress(t.encode(), 3) for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]}


def remove_repeats(docs: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """doc_id, sd_n_bytes, sd_spans (merged, in bytes of the UTF-8 text) and sd_kept (the bytes that stay), for each row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id, all judged
    on the input. Null texts are empty. A null doc_id counts as the largest one; rows with one doc_id don't count as
    repeats of each other. Texts of fewer than LENGTH bytes stay.

    The windows are shuffled packed, in buckets whose number follows the input, and the texts once, compressed each for
    itself, to their spans. Up to FAN buckets the windows are shuffled once; beyond, each round of shuffles deals a bucket
    FAN ways at most, by longer grams, which takes apart what a frequent short gram has brought together. Strings that a
    third of all documents hold are sent once a step and round. A very long text is read in pieces that overlap. An
    empty table gives no rows; other columns than doc_id and text are not looked at.

    Rows that repeat a doc_id, and rows of null doc_ids, are told apart by 64 bits of a text hash.
    """
    spark = docs.sparkSession
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    hashed = F.lit(True) if not ids.where("n > 1").isEmpty() else F.col("doc_id").isNull()  # where all ids differ, they need no hash beside them
    row = F.when(hashed, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("sd_id"), row.alias("sd_row"), "doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = partitions(spark)
    first, *later = rounds(max(n, -(-total // block)), fan)
    packed = base.where(F.col("text").isNotNull()).select("sd_id", "sd_row", "text").mapInArrow(pack_segments(first), PACKED)
    for i, f in enumerate(later):
        packed = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(deal_again(f, min(i + 2, 4)), PACKED)
    spans = packed.groupBy("bucket").applyInArrow(repeats_of_block, "sd_id long, sd_row long, sd_start long, sd_end long")
    spans = spans.groupBy("sd_id", "sd_row").agg(F.collect_list(F.struct("sd_start", "sd_end")).alias("sd_found"))
    texts = append_columns(base, lambda: squeeze, [T.StructField("sd_text", T.BinaryType())], keep=["sd_id", "sd_row", "doc_id"])
    both = texts.join(spans, ["sd_id", "sd_row"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType([T.StructField("doc_id", T.LongType()), *RESULT]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, runs, kept = [], [], []
                for blob, found in zip(part.column(part.schema.get_field_index("sd_text")).to_pylist(), part.column(part.schema.get_field_index("sd_found")), strict=True):
                    text = b"" if blob is None else zstandard.decompress(blob)
                    merged: list[list[int]] = []
                    if found.is_valid:
                        pairs = found.values
                        both_ = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()])
                        both_ = both_[:, np.argsort(both_[0], kind="stable")]
                        reach = np.maximum.accumulate(both_[1])
                        new = np.concatenate(([True], both_[0][1:] > reach[:-1]))
                        merged = list(zip(both_[0][new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist(), strict=True))
                    stay, end = [], 0
                    for a, z in merged:
                        stay.append(text[end:a])
                        end = z
                    sizes.append(len(text))
                    runs.append([{"start": a, "end": z} for a, z in merged])
                    kept.append(b"".join([*stay, text[end:]]))
                columns = [part.column(part.schema.get_field_index("doc_id")), sizes, runs, kept]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return both.mapInArrow(cut, T.StructType([T.StructField("doc_id", T.LongType()), *RESULT]))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with strings of 50 bytes; the kept bytes as their digest."""
    d = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("sd_spans", F.lit(0).cast("long"), lambda s, x: s + x.getField("end") - x.getField("start"))
    return d.select("doc_id", F.col("sd_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("sd_spans").cast("long").alias("n_spans"), F.sha2("sd_kept", 256).alias("kept_sha256"))
