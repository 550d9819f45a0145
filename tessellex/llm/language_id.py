"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text of each language reads a document and ends a phrase wherever the longest match
ends. The cross-parsing estimate of the entropy is phrases * log2(learned symbols) / symbols; the least one wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, append_columns, table

#: Symbols of a lane. The lanes of a chunk are parsed together; where a phrase crosses into a lane, that lane is parsed again.
LANE = 512
#: The most frequent symbols of a language have a column each in its table of transitions; the others' are searched.
DENSE = 127
UNKNOWN = "und"


def symbol_table(letters: str) -> np.ndarray:
    """By code point: 0 for what is no letter, the number of the letter lower-cased, or one more for letters not learned."""
    known = {c: i + 1 for i, c in enumerate(letters)}
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = known.get(c.lower(), len(letters) + 1)
    return out


def symbols_of(texts: list[str | None], to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, bounds, lettered): the texts as letters and single separators, without those at their ends."""
    texts = [t or "" for t in texts]
    codes = to[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = codes != 0
    inner = np.zeros(len(codes), bool)  # separators that follow a letter; the one before the text's end goes below
    inner[1:] = ~keep[1:] & keep[:-1]
    kept = np.cumsum(keep | inner)
    last = kept[ends - 1]
    out, bounds = codes[keep | inner], np.concatenate(([0], last))
    first, end = bounds[:-1], bounds[1:].copy()
    trailing = (end > first) & (out[np.maximum(end - 1, 0)] == 0) if len(out) else np.zeros(len(first), bool)
    return out, np.stack([first, end - trailing]), end - trailing > first


class Automaton:
    """The suffix automaton of codes below width. State 0 is the start, and no transition leads there.

    Codes are numbered anew by their frequency, so that a table of states * (DENSE + 1) holds nearly all transitions;
    those by rarer codes are a sorted list, of at most three times as many entries as there are codes.
    """

    def __init__(self, codes: np.ndarray, width: int) -> None:
        count = np.bincount(codes, minlength=width)
        order = np.argsort(-count, kind="stable")
        self.number = np.empty(width, np.int64)
        self.number[order] = np.arange(width)
        step = suffix_automaton(self.number[codes].tolist())
        self.columns = min(width, DENSE + 1)
        self.dense = np.zeros(len(step) * self.columns, np.int32)
        self.width, rare = width, []
        for s, to in enumerate(step):
            for c, t in to.items():
                if c < self.columns:
                    self.dense[s * self.columns + c] = t
                else:
                    rare.append((s * width + c, t))
        rare.sort()
        self.keys, self.to = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)

    def __call__(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that follow by c (new numbers), 0 where there is none."""
        if self.columns == self.width:
            return self.dense[state * self.columns + c]
        out = self.dense[state * self.columns + np.minimum(c, self.columns - 1)]
        rare = np.flatnonzero(c >= self.columns)
        if len(rare):
            key = state[rare].astype(np.int64) * self.width + c[rare]
            at = np.searchsorted(self.keys, key)
            out[rare] = np.where(np.append(self.keys, -1)[at] == key, np.append(self.to, 0)[at], 0)
        return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def walk(codes: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, begins: np.ndarray, step: Automaton, until: bool) -> np.ndarray:
    """Parses the lanes codes[start[i]:start[i] + size[i]] from the states given and marks in begins where phrases begin.

    Returns the states in the end. With until, a lane ends, with state -1, at the first phrase that begins where begins
    has one already: from there on all is as it was.
    """
    order = np.argsort(-size, kind="stable")
    at, left, own = start[order], size[order], order
    now, out = state[order].astype(np.int32), np.empty(len(start), np.int32)
    while len(at):
        done = int(left[-1])  # the shortest of the lanes that are left
        for t in range(done):
            c = codes[at + t]
            to = step(now, c)
            begin = (now == 0) | (to == 0)
            stuck = np.flatnonzero((to == 0) & (now != 0))
            if len(stuck):
                to[stuck] = step(np.zeros(len(stuck), np.int32), c[stuck])  # where that fails too, the symbol is a phrase of its own
            if until:
                met = begin & begins[at + t]
                begins[at + t] = begin
                if met.any():
                    out[own[met]] = -1
                    stay = ~met
                    at, left, own, now, to = at[stay], left[stay], own[stay], now[stay], to[stay]
                    if not len(at):
                        return out
            else:
                begins[at + t] = begin
            now = to
        at, left = at + done, left - done
        ended = left == 0
        out[own[ended]] = now[ended]
        stay = ~ended
        at, left, own, now = at[stay], left[stay], own[stay], now[stay]
    return out


def phrases(codes: np.ndarray, first: np.ndarray, last: np.ndarray, step: Automaton, lane: int = LANE) -> np.ndarray:
    """Phrases of each text codes[first[i]:last[i]]: each is the longest match from where it begins, or one symbol.

    Lanes of a text are parsed at once, as if a phrase began with each. Then the phrase that is open at the end of a lane
    goes on into the next one, up to where both agree on the beginning of a phrase, which takes some phrases at most of
    ordinary texts; this goes on while ends of lanes change, so that the count is that of one parse from the start.
    """
    codes = step.number[codes]
    lanes = -(-(last - first) // lane)
    text = np.repeat(np.arange(len(first)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = first[text] + nth * lane
    size = np.minimum(lane, last[text] - start)
    begins = np.zeros(len(codes), bool)
    state = walk(codes, start, size, np.zeros(len(start), np.int32), begins, step, until=False)
    again = np.flatnonzero(nth > 0)
    again = again[state[again - 1] != 0]
    while len(again):
        ends = walk(codes, start[again], size[again], state[again - 1], begins, step, until=True)
        changed = (ends >= 0) & (ends != state[again])
        state[again[changed]] = ends[changed]
        again = again[changed] + 1
        again = again[again < len(text)]
        again = again[nth[again] > 0]
    return np.bincount(text, weights=np.add.reduceat(begins, start, dtype=np.int64) if len(start) else None, minlength=len(first))


def learn(docs: DataFrame, max_symbols: int = 24_000, max_docs: int = 200, max_chars: int = 20_000, max_languages: int = 256, seed: int = 11) -> dict:
    """The automata of the languages in docs (text, lang, doc_id): about max_docs documents each at most, chosen by a hash of doc_id.

    Of these, in the order of the hash, whole texts, and of one longer than max_chars so many from a place that the hash
    chooses, until there are max_symbols. Languages are the max_languages with the most labelled texts. This bounds what
    comes to the driver (max_languages * max_docs * max_chars characters) and goes to each executor (languages * 2 *
    max_symbols * 128 * 4 bytes). Of the letters the 65,000 most frequent in the sample are told apart. Null texts and
    null languages aren't learned; without any other, the model knows no language.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = docs.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    limits = spark.createDataFrame([(r.lang, int(min(1.0, max_docs / r.n) * (1 << 30))) for r in counts], "lang string, li_limit long")  # max_languages rows
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.greatest(F.lit(1), F.char_length("text") - max_chars + 1)).cast("int")
    part = F.when(F.char_length("text") <= max_chars, F.col("text")).otherwise(F.substring(F.col("text"), place + 1, F.lit(max_chars)))
    sample = docs.join(F.broadcast(limits), "lang").where(F.col("text").rlike(r"\p{L}") & (h < F.col("li_limit")))
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.select("lang", part.alias("text"), h.alias("h")).collect(), key=lambda r: (r.lang, r.h, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    seen: dict[str, int] = {}
    for c in (c for ts in texts.values() for t in ts for c in t if c.isalpha()):
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
    letters = "".join(sorted(sorted((c for c in seen if len(c) == 1), key=lambda c: (-seen[c], c))[:65_000]))
    to, models = symbol_table(letters), []
    for lang in sorted(texts):
        parts: list[np.ndarray] = []
        for t in texts[lang]:
            codes, bounds, _ = symbols_of([t], to)
            parts += [codes[bounds[0, 0] : bounds[1, 0]], np.zeros(1, np.uint16)]
            if sum(map(len, parts)) >= max_symbols:
                break
        codes = np.concatenate(parts)[:max_symbols]
        models.append((lang, math.log2(max(2, len(codes))), Automaton(codes, len(letters) + 2)))
    return {"letters": letters, "models": models}


@any_names("li_")
def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id where None), then li_lang, li_score (0 to 1), li_entropy (bits a symbol; null for und) and li_lettered.

    li_lang is `und` where the text is null or has no letter (li_lettered is false), or nothing was learned. Ties go to the first language by
    code points. li_score is 1 - least / second least entropy: 0 where two languages explain the text alike. Every
    symbol of a text is parsed, whatever its length. Rows are judged each for itself: repeats get equal results, an empty
    table gives no rows, nothing is shuffled or depends on other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep

    def make():
        m = shared.value
        to, langs = symbol_table(m["letters"]), [x[0] for x in m["models"]]

        def work(batch: pa.RecordBatch) -> dict:
            codes, (first, last), lettered = symbols_of(batch.column("text").to_pylist(), to)
            if not langs:
                return {"li_lang": [UNKNOWN] * len(first), "li_score": np.zeros(len(first)), "li_entropy": [None] * len(first), "li_lettered": lettered.tolist()}
            n = np.maximum(last - first, 1)
            h = np.stack([phrases(codes, first, last, step) * bits / n for _, bits, step in m["models"]])
            best = h.argmin(axis=0)
            low = np.sort(h, axis=0)
            score = 1 - low[0] / np.maximum(low[1], 1e-12) if len(langs) > 1 else np.ones(len(first))
            return {
                "li_lang": [langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered.tolist(), strict=True)],
                "li_score": np.where(lettered, np.clip(score, 0, 1), 0.0),
                "li_entropy": [e if x else None for e, x in zip(low[0].tolist(), lettered.tolist(), strict=True)],
                "li_lettered": lettered.tolist(),
            }

        return work

    fields = [T.StructField("li_lang", T.StringType()), T.StructField("li_score", T.DoubleType()), T.StructField("li_entropy", T.DoubleType()), T.StructField("li_lettered", T.BooleanType())]
    return append_columns(docs.select(*dict.fromkeys([*keep, "text"])), make, fields, keep=keep, limit=4 << 20)


def fold(docs: DataFrame, parts: int) -> F.Column:
    """crc32(doc_id as text) mod parts; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with a null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold(docs, 3) != 1))
    d = identify(docs, model)
    return d.select("doc_id", F.coalesce(fold(d, 3) == 1, F.lit(False)).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"))
