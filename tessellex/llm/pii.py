"""PII: fixed patterns, and contextual extraction that is bootstrapped from what they find."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits starts: from within the run it would fail where it fails from its start
IP = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What may be an identifier: four characters or more; a digit or a sign inside marks it.
IDENTIFIER = re.compile(r"[^\W_](?:[^\W_]|[-_.@](?=[^\W_])){3,}")
MARK = re.compile(r"\d|[_.@](?=[^\W_])")
#: Between a word that introduces a value and the value: `word: value`, `word = "value"`. Any value of four characters or more may be an identifier there.
SEPARATOR = re.compile(r"[:=#]")
KEY = re.compile(r"([^\W\d_]+)[\"']?\x20*$")
QUOTE = re.compile(r"\x20*[\"']?")
#: Numbers in groups, and names behind an @, may be identifiers, too.
GROUPED = re.compile(r"(?<![\w.(-])\(?[0-9]{2,}\)?(?:[ ./-][0-9]{2,})+(?![\w-])")
HANDLE = re.compile(r"(?<![\w.@])@[^\W_](?:[^\W_]|[_.-](?=[^\W_])){2,}")
#: Credentials are no personal data: what a secret scan finds by fixed patterns is no candidate.
CREDENTIAL = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]+|[0-9a-f]{24,}")
#: How much a value of unknown kind counts against a pattern, a seed counting one for it.
DOUBT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the local class, an @ and two domain labels or more, one @ after the other in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(a, 0, z) for a, z in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def key_before(text: str, start: int) -> str | None:
    """The word that introduces a value with a separator, directly before start."""
    at = start - 1
    while at >= 0 and text[at] in "\"'":
        at -= 1
    while at >= 0 and text[at] == " ":
        at -= 1
    if at < 0 or not SEPARATOR.match(text[at]):
        return None
    key = KEY.search(text[max(0, at - 40) : at])
    return key.group(1).lower() if key else None


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the two words before, the words before and after, and the word that introduces the value."""
    before = [w.lower() for w in WORD.findall(text, max(0, start - 60), start)][-2:]
    after = [w.lower() for w in WORD.findall(text, end, end + 40)][:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    key = key_before(text, start)
    if key:
        out.append(f"{key}: _")
    return out


SPAN = [T.StructField(n, T.LongType()) for n in ("start", "kind", "end")]
SPANS = T.ArrayType(T.StructType(SPAN))
CONTEXTS = T.ArrayType(T.StructType([*SPAN, T.StructField("value", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what may be an identifier and overlaps no span of found and no credential, in order, the longest of one start."""
    near, done = {}, 0
    for sep in SEPARATOR.finditer(text):  # values that a word introduces need no mark
        value = IDENTIFIER.match(text, QUOTE.match(text, sep.end()).end())
        if value and KEY.search(text[max(0, sep.start() - 40) : sep.start()]):
            near[value.start()] = value.end()
    for pattern, sign in ((HANDLE, "@" in text), (GROUPED, DIGIT.search(text))):
        for m in pattern.finditer(text) if sign else ():
            near[m.start()] = max(m.end(), near.get(m.start(), 0))
    mark = MARK.search(text)
    while mark:
        start = mark.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "-_.@"):
            start -= 1
        while not text[start].isalnum():
            start += 1
        m = IDENTIFIER.match(text, start)
        if m and m.end() > mark.start():
            near[start] = max(m.end(), near.get(start, 0))
        done = max(mark.end(), m.end() if m else 0)
        mark = MARK.search(text, done)
    out, reach = [], 0
    spans = iter(sorted([*((a, z) for a, _, z in found), *(m.span() for m in CREDENTIAL.finditer(text))]) if near else ())
    ahead = next(spans, None)
    for a, z in sorted(near.items()):
        while ahead and ahead[0] < z:
            reach, ahead = max(reach, ahead[1]), next(spans, None)
        if a >= reach:
            out.append((a, z))
            reach = z
    return out


def occurrences(batch: pa.RecordBatch) -> dict:
    """Base spans, and of these and of other identifiers the values and patterns."""
    base, seen = [], []
    for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
        found = base_spans(text) if text else []
        own = [{"start": a, "kind": k, "end": z, "value": text[a:z], "seed": True, "patterns": patterns_of(text, a, z)} for a, k, z in found]
        if text:
            own += [{"start": a, "kind": 4, "end": z, "value": text[a:z], "seed": False, "patterns": patterns_of(text, a, z)} for a, z in candidates(text, found)]
        base.append([{"start": a, "kind": k, "end": z} for a, k, z in found])
        seen.append(own)
    return {"pi_base": base, "pi_seen": seen}


def bootstrap(edges: DataFrame, rounds: int, min_seeds: int, min_score: float) -> DataFrame:
    """Patterns (pattern, p) of high confidence. edges: pattern, value, seed (whether a fixed pattern found the value), distinct.

    A pattern's score is the sum of its values' scores over their weights: a seed has the score and weight 1, another value the noisy-or of the patterns around it
    that count, and DOUBT of what that lacks as weight. It counts only with min_seeds distinct values that score above 0.5.
    Each round is two aggregates of the edges, and sums combine before their shuffle; nothing comes to the driver.
    """
    scored = edges.withColumn("s", F.col("seed").cast("double"))
    for i in range(rounds):
        weight = F.col("s") + DOUBT * (1 - F.col("s"))
        patterns = scored.groupBy("pattern").agg((F.sum("s") / F.sum(weight)).alias("p"), F.sum((F.col("s") > 0.5).cast("long")).alias("n"))
        patterns = materialize(patterns.where((F.col("n") >= min_seeds) & (F.col("p") >= min_score)))
        if i + 1 < rounds:
            values = edges.where("not seed").join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p")))))).alias("v"))
            scored = materialize(edges.join(values, "value", "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("v", F.lit(0.0)))).drop("v"))
    return patterns.select("pattern", "p")


def find_pii(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.6, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, pi_base and pi_spans: arrays of struct(start, kind, end) in code points, kind the number in KINDS.

    pi_base are the spans of the fixed patterns. pi_spans are these and, as "context", identifiers that overlap none of
    them and stand in a pattern of high confidence. The seeds are the spans of the fixed patterns alone; a pattern is what stands around a
    value: two words before it, a word on either side, or a word and a separator that introduce it. Null and empty texts have no spans. Repeated rows get equal spans,
    null ids are rows like others, an empty table gives no rows. Texts are read whole, in time that grows with their
    length alone. No text is shuffled: what a text holds goes to a table, and the graph of patterns and values comes
    from there. Columns in keep may have any name.
    """
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("pi_row"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("pi_keep"))
    d = append_columns(d, lambda: occurrences, [T.StructField("pi_base", SPANS), T.StructField("pi_seen", CONTEXTS)], keep=["doc_id", "pi_keep", "pi_row"])
    d = materialize(d)
    key = [F.coalesce("doc_id", F.lit(2**63 - 1)).alias("pi_id"), "pi_row"]
    seen = d.where(F.size("pi_seen") > 0).select(*key, F.explode("pi_seen").alias("o")).select("pi_id", "pi_row", "o.*")
    seen = materialize(seen.select("pi_id", "pi_row", "start", "kind", "end", "value", "seed", F.explode("patterns").alias("pattern")))
    seeds = seen.where("seed").select("value").distinct().withColumn("seed", F.lit(True))
    edges = seen.groupBy("pattern", "value").agg(F.count("*")).join(seeds, "value", "left")  # a seed is one wherever it stands
    edges = materialize(edges.select("pattern", "value", F.coalesce("seed", F.lit(False)).alias("seed")))
    good = bootstrap(edges, rounds, min_seeds, min_score).select("pattern")
    more = seen.where("kind = 4").join(good, "pattern", "left_semi").groupBy("pi_id", "pi_row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("pi_more"))
    both = d.withColumns({"pi_id": key[0]}).join(more, ["pi_id", "pi_row"], "left")
    return both.select("doc_id", *[F.col(f"pi_keep.`{c}`").alias(c) for c in keep], "pi_base", F.array_sort(F.concat("pi_base", F.coalesce("pi_more", F.array().cast("array<struct<start:bigint,kind:bigint,end:bigint>>")))).alias("pi_spans"))


def joined(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s.getField("kind").cast("int")), s.getField("start"), s.getField("end"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the counts and the digest are of the fixed patterns, spans has those of learned contexts, too."""
    d = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("pi_base", lambda s: s.getField("kind") == k)).cast("long")
    return d.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(joined("pi_base"), 256).alias("base_sha256"), joined("pi_spans").alias("spans"))
