"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the windows around what they find."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shingler, any_names, append_columns, materialize, table

TOKEN = re.compile(r"[^\W_]+(?:[@$_]+[^\W_]+)*")
#: Digits and signs that stand for letters in misspelled words.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
QUOTES = frozenset("\"“”«»„‟")
#: Words near a term that report it rather than use it, in English, French, German and Spanish.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quotes quote quoting reported reports stated word words term terms phrase insult slur "
    "dit écrit cité cite citation appelé mot mots terme insulte sagte schrieb zitiert zitat nannte wort wörter begriff beleidigung dijo escribió citó cita llamó palabra palabras término insulto".split()
)
WINDOW = 5
#: What a misspelled term counts, a term being 1, before its own weight is learned. The edits allowed follow the length, so all count alike.
DISCOUNT = 0.9


#: A term that ends so is a stem: any token that starts with it counts.
STEM = "*"


def allowed(term: str) -> int:
    """Edits within which a token counts as the term; stems count as they are."""
    return 0 if term.endswith(STEM) or len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The product of the terms' Levenshtein automata and their trie, made deterministic as tokens need it.

    A state is a set of (trie node, edits so far); nodes below which no term allows as many edits are left out. A token
    that cannot become a term any more is in the empty state and is given up at once.
    """

    def __init__(self, terms: list[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: dict[int, str] = {}  # apart from the words, of which one may be the same letters
        self.most = [0]
        for t in terms:
            node, path = 0, [0]
            for c in t.removesuffix(STEM):
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.step[node][c]
                path.append(node)
            if t.endswith(STEM):
                self.stem[node] = t
            else:
                self.term[node] = t
            for p in path:
                self.most[p] = max(self.most[p], allowed(t))
        self.letters = {c: c for t in terms for c in t}  # all others move alike
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closure({(0, 0)}))

    def _closure(self, items: set) -> frozenset:
        """With what skipping letters of terms reaches; of a node only its fewest edits."""
        best: dict[int, int] = {}
        todo = [(n, e) for n, e in items if e <= self.most[n]]
        while todo:
            node, edits = todo.pop()
            if best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(n, edits + 1) for n in self.step[node].values() if edits + 1 <= self.most[n]]
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
            found = [(e, self.term[n]) for n, e in s if self.term[n] is not None and e <= allowed(self.term[n])]
            self.ends.append((min(found)[1], min(found)[0]) if found else None)
            self.stems.append(min((self.stem[n] for n, e in s if n in self.stem and e == 0), default=None))
        return self.states[s]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if c in self.step[node]:
                out.add((self.step[node][c], edits))
            out.add((node, edits + 1))
            out.update((n, edits + 1) for n in self.step[node].values())
        return self._state(self._closure(out))

    def find(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed edits."""
        state, stem, letters = self.start, None, self.letters
        for c in token:
            c = letters.get(c, "")
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            if to == self.dead:
                return stem
            state = to
            if self.stems[state]:
                stem = (self.stems[state], 0)
        return stem or self.ends[state]


def fold(token: str) -> str:
    """Lower-cased, lookalikes as letters where there are letters too, letters that come three times or more once."""
    token = token.lower()
    if not token.isalpha() and any(c.isalpha() for c in token):
        token = token.translate(LOOKALIKE)
    return re.sub(r"(.)\1\1+", r"\1", token)


class Finder:
    """Hits of a text: (token number, token, term, edits, quoted). Tokens are judged once each, as far as the memo reaches."""

    MEMO = 200_000

    def __init__(self, terms: list[str], ordinary: frozenset[str]) -> None:
        self.matcher, self.ordinary, self.memo = Matcher(terms), ordinary, {}

    def judge(self, token: str) -> tuple[str, int] | None:
        folded = fold(token)
        hit = self.matcher.find(folded) if len(folded) > 2 else None
        if hit and (hit[1] or folded != token.lower()) and token.lower() in self.ordinary:
            return None
        return (hit[0], hit[1] + (folded != token.lower())) if hit else None

    def __call__(self, text: str | None) -> list[tuple[int, str, str, int, bool]]:
        if not text:
            return []
        tokens = TOKEN.findall(text)
        memo = self.memo
        if new := {t for t in tokens if t not in memo}:
            if len(memo) > self.MEMO:
                memo.clear()
                new = set(tokens)
            for t in new:
                memo[t] = self.judge(t)
        at = [i for i, t in enumerate(tokens) if memo[t]]
        if not at:
            return []
        where = [m.start() for m in TOKEN.finditer(text)]
        out, reached, marks = [], 0, 0  # marks: quotation marks of the line up to what is reached
        for i in at:
            line = text.rfind("\n", reached, where[i]) + 1
            if line:
                reached, marks = line, 0
            marks += sum(text.count(q, reached, where[i]) for q in QUOTES)
            reached = where[i]
            inside = marks % 2 == 1
            near = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
            out.append((i, tokens[i], *memo[tokens[i]], inside or any(t.lower() in REPORTING for t in near)))
        return out


def features(hits: list[tuple[int, str, str, int, bool]]) -> list[float]:
    """Terms that are used, terms that are quoted, both less for misspelled ones; how many of the used ones are misspelled, and stand in each other's windows.

    A misspelled term counts with the weight of the terms, a little less. Its own feature only corrects that
    where the labels say so, since samples may hold few or none.
    """
    used = [h for h in hits if not h[4]]
    close = sum(b[0] - a[0] <= WINDOW for a, b in zip(used, used[1:], strict=False))
    weigh = lambda x: sum(DISCOUNT if h[3] else 1.0 for h in x)
    return [math.log1p(x) for x in (weigh(used), weigh(h for h in hits if h[4]), sum(h[3] > 0 for h in used), close)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the last one the constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def forms(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and their stems of four to seven letters."""
    words = {t.lower() for t in TOKEN.findall(text or "")}
    return words | {w[:k] + STEM for w in words for k in range(4, 8) if len(w) > k}


def form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (form, toxic documents, other documents), combined a batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(forms(text))
        found = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"form": pa.array(found, pa.string()), "t": pa.array([counts[1][w] for w in found], pa.int64()), "c": pa.array([counts[0][w] for w in found], pa.int64())})


def least_shingle():
    """For append_columns: the least shingle hash of a text, which near copies mostly share."""
    shingler = Shingler()

    def work(batch: pa.RecordBatch) -> dict:
        hashes, at = shingler(batch.column(batch.schema.get_field_index("text")))
        return {"least": [int(hashes[a:z].min().astype(np.int64)) if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}

    return work


def choose(found: list[tuple[str, int]]) -> list[str]:
    """Of forms and their toxic counts: no stem that begins with a chosen one or that a chosen longer form all but equals.

    Words stay beside the stems they begin with, since only words are found with edits.
    """
    out: list[tuple[str, int]] = []
    for form, t in sorted(found, key=lambda x: (-x[1], x[0].endswith(STEM), -len(x[0]), x[0])):
        bare = form.removesuffix(STEM)
        if not (form.endswith(STEM) and any(o.endswith(STEM) and bare.startswith(o[:-1]) or o.removesuffix(STEM).startswith(bare) and n >= 0.95 * t for o, n in out)):
            out.append((form, t))
    return [o for o, _ in out]


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000, max_terms: int = 2_000, seed: int = 5) -> dict:
    """Lexicon, ordinary words near it, and weights, from a sample of about max_docs labelled documents at most.

    The sample is chosen by a hash of doc_id; of texts that share their least shingle, as near copies do, one counts for
    the lexicon. Terms are words and stems of which 0.6 of the documents are toxic, by chance in fewer than one lexicon
    in a hundred (Chernoff's bound), max_terms candidates at most. Ordinary words are within the allowed edits of a term, yet
    occur in more than one clean document.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_docs / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the sample is max_docs rows by its parameter, so it may be broadcast; no text is shuffled
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = materialize(append_columns(sample, least_shingle, [T.StructField("least", T.LongType())]))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    rate = (toxic + 0.5) / (n + 1)
    if not 0 < toxic < n:
        return {"terms": [], "ordinary": [], "weights": None, "rate": min(rate, 0.49)}
    single = sample.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    counts = materialize(single.mapInArrow(form_counts, "form string, t long, c long").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    total, p = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    gain = total * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    good = counts.where((F.col("t") > 1) & (p >= 0.6) & (F.char_length("form") > 2)).withColumn("gain", gain).where(F.col("gain") > math.log(100 * max(1, counts.count())))
    terms = choose([(r.form, r.t) for r in good.orderBy(F.desc("gain"), "form").limit(max_terms).collect()])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if (hit := matcher.find(fold(w))) and hit[0] != w]
            yield pa.RecordBatch.from_pydict({"form": pa.array(found, pa.string())})

    words = counts.where((F.col("c") > 1) & ~F.endswith("form", F.lit(STEM))).select("form")
    ordinary = [r.form for r in words.mapInArrow(near, "form string").orderBy("form").collect()] if terms else []

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms, frozenset(ordinary))
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([features(finder(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "y": batch.column(1)})

    rows = sorted(sample.select("text", "toxic").mapInArrow(described, "x array<double>, y int").collect())  # max_docs rows
    weights = fit(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    return {"terms": terms, "ordinary": ordinary, "weights": weights.tolist(), "rate": rate}


HIT = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("word", T.StringType()), T.StructField("term", T.StringType()), T.StructField("edits", T.LongType()), T.StructField("quoted", T.BooleanType())]))


@any_names("tx_")
def score_toxicity(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id where None), then tx_score (0 to 1) and tx_hits (token number, word, term, edits, quoted).

    Every token of a text is judged. Null and empty texts have no hits and the score of such texts. Without toxic or
    without clean labels nothing is learned, and every score is the base rate, 0.49 at most. Rows are scored each for
    itself, so repeats and other columns don't matter; time grows with the text's length alone. An empty table gives no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_terms terms and their neighbours
    keep = ["doc_id"] if keep is None else keep

    def make():
        m = shared.value
        finder = Finder(m["terms"], frozenset(m["ordinary"]))
        names = ("token", "word", "term", "edits", "quoted")

        def work(batch: pa.RecordBatch) -> dict:
            hits = [finder(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            if m["weights"] is None:
                score = np.full(len(hits), m["rate"])
            else:
                w = np.array(m["weights"])
                score = 1 / (1 + np.exp(-np.clip(np.array([features(h) for h in hits]).reshape(-1, len(w) - 1) @ w[:-1] + w[-1], -30, 30)))
            return {"tx_score": score, "tx_hits": [[dict(zip(names, h, strict=True)) for h in hs] for hs in hits]}

        return work

    return append_columns(docs.select(*dict.fromkeys([*keep, "text"])), make, [T.StructField("tx_score", T.DoubleType()), T.StructField("tx_hits", HIT)], keep=keep)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a null doc_id don't count; a document with a null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = learn(docs.select("doc_id", "text").where(~held), table(spark, sf_dir, "labels"))
    d = score_toxicity(docs, model)
    return d.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("tx_score").alias("score"), F.when(F.col("tx_score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("tx_hits").cast("long").alias("n_hits"))
