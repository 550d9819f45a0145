"""Exact dedup against grouping by normalised texts in Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessellex.llm import exact_dedup

BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(BLANK)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for k, members in groups.items():
        members.sort()
        out += [(m[3], members[0][3], len(members), n == 0, k) for n, m in enumerate(members)]
    return out


def bag(x):
    return sorted(map(repr, x))


def same(got, rows):
    import hashlib

    want = [(i, keep, n, kept, hashlib.sha256(k.encode()).hexdigest()) for i, keep, n, kept, k in brute(rows)]
    assert bag(map(tuple, got.collect())) == bag(want)


@pytest.mark.parametrize("block", [1024, 50, 3])
def test_edges(docs, rows, none, block):
    """Nulls, empty, blank and long texts, repeated rows and ids, other columns of any name."""
    rows = [(i, t) for i, t in rows if block > 3 or len(t or "") < 1000]
    docs = docs.where(F.lit(block > 3) | (F.char_length(F.coalesce("text", F.lit(""))) < 1000))
    same(exact_dedup.exact_duplicates(docs.withColumn("ed_name", F.lit(1)).withColumn("ed_row", F.lit("x")), block), rows)
    assert exact_dedup.exact_duplicates(none, block).count() == 0


def test_texts_that_differ_late_and_in_length(spark):
    """Texts of shared blocks only: prefixes of each other, swapped blocks, one letter at the end, spaces anywhere."""
    a, b, c = "a" * 16, "b" * 16, "cdefghijklmnopqr"
    texts = [a, a + a, a + a + a, a * 4, a * 5, a + b, b + a, a + b + a, b + a + a, a + a + b, (a + b + c) * 7, (a + b + c) * 7 + "x", (a + b + c) * 7 + "y", c + b + a, " ".join(a + b), a + "\n" + b, a + "é", a + "é ", "", " \n"]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(100 + i, t + " ") for i, t in enumerate(texts)]
    same(exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16), rows)


def test_names_are_exact_whatever_the_hash(spark):
    """Keys of one hash, and a key that fills several ranges, have one name each."""
    rows = [(i, None, None, None, 0, bytes([65 + i % 7]) * 3 if i % 2 else b"hot") for i in range(4000)]
    keyed = spark.createDataFrame(rows, exact_dedup.PIECES)
    for hash_of in (F.xxhash64, lambda c: F.lit(5), F.octet_length):
        got = exact_dedup.named(keyed, 8, hash_of).select("ed_row", "ed_name", "ed_part").collect()
        key = {r[0]: r[5] for r in rows}
        assert len({(key[r.ed_row], r.ed_name) for r in got}) == len(set(key.values())) == len({r.ed_name for r in got})
        assert len({r.ed_part for r in got if key[r.ed_row] == b"hot"}) > 2


def test_levels(spark):
    """A text of 2**k blocks takes k levels; one with a block of its own ends at the first, unless that block ends a range."""
    texts = ["x" * 16 + "y" * 16] * 2 + [f"{'x' * 20}{i:04}{'y' * 8}" for i in range(200)]
    got = exact_dedup.name_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 4).collect()
    assert [r.ed_level for r in got if r.ed_id < 2] == [3, 3]
    assert sum(r.ed_level == 0 and r.ed_name is None for r in got) >= 150
