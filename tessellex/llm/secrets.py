"""Secret scans [native]: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import importlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, let, table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "markov")
# "\x20" and the classes are ASCII; only the keyword is matched in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run of one class is one match whatever its length, so the least lengths of 20 and 24 can stand in the pattern
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weight of the single symbols beside the counts of pairs.
BACK_OFF = 5.0
#: Runs of such symbols, which the models judge. A run starts where no symbol stands before it.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"


def running(x: Column, n: Column) -> Column:
    """Sums of the elements before each of the n elements of x, in n ** 1.5 steps: first over blocks of sqrt(n), then within."""
    c = F.ceil(F.sqrt(n)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)

    def within(k: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), k.getField("c") - 1), lambda i: total(F.slice(k.getField("x"), i * k.getField("c") + 1, k.getField("c"))))
        before = let(F.struct(sums.alias("s"), k.getField("c").alias("c")), lambda b: F.transform(F.sequence(F.lit(0), b.getField("c") - 1), lambda i: total(F.slice(b.getField("s"), F.lit(1), i))))
        return let(
            F.struct(before.alias("b"), k.getField("x").alias("x"), k.getField("c").alias("c")),
            lambda b: F.transform(b.getField("x"), lambda _, i: F.get(b.getField("b"), F.floor(i / b.getField("c")).cast("int")) + total(F.slice(b.getField("x"), i - i % b.getField("c") + 1, i % b.getField("c")))),
        )

    return let(F.struct(x.alias("x"), c.alias("c")), within)


def spans(text: Column, pattern: str, kind: str, least: int, group: int = 0, more: bool = False) -> Column:
    """array<struct<start,kind,end[,text]>>: leftmost matches that don't overlap, those whose group has least code points at least.

    Starts and ends are code points, the end exclusive. What stands between the matches comes from split() with the
    same pattern, so positions are sums of lengths.
    """
    fields = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.char_length).alias("gap")]
    if group:
        fields.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length).alias("own"))

    def place(x: Column) -> Column:
        size = F.transform(x.getField("m"), F.char_length)
        width = F.zip_with(F.slice(x.getField("gap"), F.lit(1), F.size(x.getField("m"))), size, lambda a, b: a + b)

        def each(y: Column) -> Column:
            own = lambda i: F.get(y.getField("x").getField("own"), i) if group else F.char_length(F.get(y.getField("x").getField("m"), i))
            made = F.transform(
                y.getField("before"),
                lambda b, i: F.struct(
                    (b + F.get(y.getField("x").getField("gap"), i)).alias("start"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (b + F.get(y.getField("x").getField("gap"), i) + F.char_length(F.get(y.getField("x").getField("m"), i))).alias("end"),
                    own(i).alias("own"),
                    *([F.get(y.getField("x").getField("m"), i).alias("text")] if more else []),
                ),
            )
            names = ["start", "kind", "end", *(["text"] if more else [])]
            return F.transform(F.filter(made, lambda s: s.getField("own") >= least), lambda s: F.struct(*[s.getField(n).alias(n) for n in names]))

        return let(F.struct(running(width, F.size(x.getField("m"))).alias("before"), x.alias("x")), each)

    none = f"array<struct<start:int,kind:int,end:int{',text:string' if more else ''}>>"
    return let(F.struct(*fields), lambda x: F.when(F.size(x.getField("m")) > 0, place(x)).otherwise(F.array().cast(none)).cast(none))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", 6, group=1), spans(text, ACCESS, "access", 20), spans(text, HEX, "hex", 24)))


def touches(own: Column, run: Column) -> Column:
    """Whether one of the spans in own, in order and apart from each other, shares a place with run: a binary search for the first that ends behind its start."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.getField("lo") + s.getField("hi")) / 2).cast("int")
        on = s.getField("lo") < s.getField("hi")
        before = F.get(own, mid).getField("end") <= run.getField("start")
        return F.struct(F.when(on & before, mid + 1).otherwise(s.getField("lo")).alias("lo"), F.when(on & ~before, mid).otherwise(s.getField("hi")).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(own) + 1.0)).cast("int"))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi")), halve).getField("lo")
    return F.coalesce(F.get(own, first).getField("start") < run.getField("end"), F.lit(False))


def code_pairs(c: Column) -> Column:
    """Numbers of the adjacent symbol pairs of a string."""
    codes = F.transform(F.split(c, ""), lambda x: F.instr(F.lit(SYMBOLS), x))
    return let(codes, lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: x * (len(SYMBOLS) + 1) + y))


#: Modules of the standard library whose public names are samples of identifiers.
NAMED = ("abc", "argparse", "ast", "asyncio", "builtins", "codecs", "collections", "concurrent.futures", "configparser", "csv", "datetime", "decimal", "email.message", "functools", "http.client", "importlib.abc", "inspect", "io",
         "json", "logging", "os", "pathlib", "pickle", "platform", "random", "re", "shutil", "signal", "socket", "ssl", "string", "subprocess", "sys", "tarfile", "threading", "tokenize", "typing", "unittest", "urllib.request", "uuid", "xml.dom.minidom", "zipfile")


def public_names() -> list[str]:
    """Names of those modules and of their classes' members, also as paths."""
    out = set()
    for name in NAMED:
        module = importlib.import_module(name)
        for x in dir(module):
            members = dir(getattr(module, x)) if isinstance(getattr(module, x), type) else []
            out |= {x, *members, *(f"/{name.replace('.', '/')}/{x}/{m}" for m in members[:8])}
    return sorted(x for x in out if not x.startswith("__"))


def identifiers(words: Column, every: int = 16) -> Column:
    """Names as programs have them, made of every so many-th three words in a row: camelCase, snake_case, kebab-case, paths, with and without version numbers."""
    digit = lambda x: F.pmod(F.xxhash64(x), F.lit(10)).cast("string")

    def forms(a: Column, b: Column, c: Column) -> Column:
        camel, d, e = F.concat(F.initcap(b), F.initcap(c)), digit(a), digit(b)
        return F.array(
            F.concat(a, camel), F.concat(F.initcap(a), camel, d), F.concat(F.initcap(a), F.lit("V"), d, camel), F.concat(a, F.initcap(b), F.lit("By"), F.initcap(c), d, F.lit("From")),
            F.concat_ws("_", a, b, c), F.concat_ws("_", a, b, F.concat(F.lit("v"), d)), F.concat_ws("_", F.concat(a, d, e), b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, F.concat(c, d)),
            F.concat(F.lit("/"), F.concat_ws("/", a, F.concat(b, d), c)), F.concat(a, F.lit("="), b, F.lit("/"), c, F.lit("_"), d, e),
        )

    at = lambda w: F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.flatten(F.transform(at(w), lambda i: forms(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def labelled_samples(docs: DataFrame, max_docs: int, seed: int) -> DataFrame:
    """(value, random): strings of a sample of about max_docs documents at most, chosen by a hash of doc_id and text.

    Random: values of the fixed patterns there, and digests in hex, base64 and letters with digits made from the seed.
    Ordinary: all runs of four symbols or more outside the patterns' spans that don't hold digits beside letters (words,
    names and numbers), identifiers made of the words, and public names of the standard library.
    """
    spark = docs.sparkSession
    share = min(1.0, max_docs / max(1, docs.count()))
    text = F.coalesce("text", F.lit(""))
    taken = docs.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).select(text.alias("text"))
    # cut the patterns out, then what is left are words
    rest = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    runs = F.filter(F.regexp_extract_all(rest, F.lit(RUN % 4), F.lit(0)), lambda x: ~(x.rlike("[0-9]") & x.rlike("[A-Za-z]")))
    made_of = F.transform(F.filter(F.regexp_extract_all(rest, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.char_length(x).between(2, 12)), F.lower)
    words = taken.select(F.explode(F.concat(runs, identifiers(made_of))).alias("value"))
    names = spark.createDataFrame([(x,) for x in public_names()], "value string").select(F.explode(F.array_repeat("value", 4)).alias("value"))  # some thousands, whatever the input
    found = F.concat(F.regexp_extract_all(F.col("text"), F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all(F.col("text"), F.lit(f"{ACCESS}|{HEX}"), F.lit(0)))
    values = taken.select(F.explode(found).alias("value")).where(F.char_length("value") >= 16)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    made = spark.range(4000).select(F.explode(F.array(digest, base64, F.translate(base64, "+/=", ""), F.translate(base64, "+/=", "-_"))).alias("value"))
    return words.unionByName(names).select("value", F.lit(0).alias("random")).unionByName(values.unionByName(made).select("value", F.lit(1).alias("random")))


def fit_llr(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the two first-order models for each pair of symbols; pairs back off to single symbols.

    Only counts of pairs come to the driver: two for each of at most 69 * 69 pairs, whatever the input.
    """
    n = len(SYMBOLS) + 1
    rows = samples.select("random", F.explode(code_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").count().collect()
    counts = [[0] * (n * n), [0] * (n * n)]
    for r in rows:
        counts[r["random"]][r["pair"]] += r["count"]
    p = []
    for m in counts:
        single = [sum(m[b::n]) + 0.5 for b in range(n)]
        before = [sum(m[a * n : a * n + n]) for a in range(n)]
        p.append([(c + BACK_OFF * single[i % n] / sum(single)) / (before[i // n] + BACK_OFF) for i, c in enumerate(m)])
    return [math.log(b / a) for a, b in zip(*p, strict=True)]


@any_names("sc_", "doc_id")
def scan_secrets(docs: DataFrame, min_chars: int = 16, min_mean: float = 1.0, min_total: float = 12.0, max_train_docs: int = 2000, seed: int = 7, keep: tuple[str, ...] = (), train: DataFrame | None = None) -> DataFrame:
    """doc_id, keep, sc_base and sc_spans: arrays of struct(start, kind, end) in order, kind the number in KINDS.

    sc_base has the spans of the fixed patterns. sc_spans has these and, as "markov", every run of min_chars symbols
    or more that no base span touches and that the model of random strings explains better than the one of
    identifiers, by min_mean nats a pair and min_total in all. Null and empty texts have no spans. Repeated rows and
    null ids are scanned like any other; nothing is compared between rows, and no shuffle carries texts. The models are
    fitted on a sample of about max_train_docs documents (of train, where that is given). Texts are scanned whole, whatever their length; positions take
    n ** 1.5 steps for n matches in a text, and which runs touch them n log n. An empty table gives no rows; the models are fitted on made samples then.
    """
    llr = fit_llr(labelled_samples((docs if train is None else train).select("doc_id", "text"), max_train_docs, seed))
    scores = F.expr("cast(split('" + ",".join(f"{x:.4f}" for x in llr) + "', ',') as array<double>)")
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("sc_text"))
    d = d.select("doc_id", *keep, base_spans(F.col("sc_text")).alias("sc_base"), spans(F.col("sc_text"), RUN % min_chars, "markov", min_chars, more=True).alias("sc_runs"))

    def like_secret(run: Column) -> Column:
        total = F.aggregate(code_pairs(run.getField("text")), F.lit(0.0), lambda s, k: s + F.get(scores, k))
        return (total >= min_total) & (total >= min_mean * (F.char_length(run.getField("text")) - 1))

    of_kind = lambda k: F.filter("sc_base", lambda b: b.getField("kind") == k)  # noqa: E731  the spans of one kind don't overlap
    d = d.withColumn("sc_kinds", F.array(*map(of_kind, range(3))))
    apart = lambda run: ~F.exists(F.col("sc_kinds"), lambda own: touches(own, run))
    found = F.transform(F.filter("sc_runs", lambda r: like_secret(r) & apart(r)), lambda r: F.struct(r.getField("start").alias("start"), r.getField("kind").alias("kind"), r.getField("end").alias("end")))
    return d.select("doc_id", *keep, "sc_base", F.array_sort(F.concat("sc_base", found)).alias("sc_spans"))


def joined(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s.getField("kind")), s.getField("start"), s.getField("end"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the counts and the digest are of the fixed patterns, spans has what the models add, too."""
    d = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("sc_base", lambda s: s.getField("kind") == k)).cast("long")
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("sc_base"), 256).alias("base_sha256"), joined("sc_spans").alias("spans"))
