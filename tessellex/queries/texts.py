"""Tokenizers, Unicode cleanup, sentence handling and vocabulary metrics over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.functions import stemmers, text
from tessellex.operators import alignment, vocabulary
from tessellex.sources import spread, table

from . import query

TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
ORTHO = r"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))"
ORTHO_TOKENS = rf"list_filter(string_split({ORTHO}, ' '), lambda x: x <> '')"
DIGEST = "len({t})::BIGINT AS n, md5(array_to_string({t}, ' ')) AS digest"


def digest(tokens) -> list:
    return [F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest")]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {DIGEST.format(t='t')} FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def q_tokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(text.tokenize(F.col("text"))))


@query(f"SELECT doc_id, {DIGEST.format(t='t')} FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), '. '), lambda x: x <> '') AS t FROM documents)")
def q_tok_delim(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(text.tokenize_at(F.col("text"), ". ")))


@query(rf"SELECT doc_id, {DIGEST.format(t='t')} FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+') AS t FROM documents)")
def q_tok_word(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(text.words(F.col("text"))))


EDGE = rf"list_filter(list_transform({TOKENS}, lambda x: regexp_replace(x, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, {DIGEST.format(t='t')} FROM (SELECT doc_id, {EDGE} AS t FROM documents)")
def q_tok_edge(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *digest(text.edge_stripped(F.col("text"))))


@query(f"SELECT doc_id, md5({ORTHO}) AS digest FROM documents")
def q_ortho(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.ortho(F.col("text"), "wide", F.col("lang"))).alias("digest"))


@query(f"SELECT doc_id, md5({ORTHO}) AS digest FROM documents")
def q_ortho_xnli(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.ortho(F.col("text"), "narrow")).alias("digest"))


@query(f"SELECT doc_id, md5({ORTHO}) AS digest FROM documents")
def q_ortho_latin(spark, sf_dir):
    """The JVM-only form for Latin texts."""
    return docs(spark, sf_dir).select("doc_id", F.md5(text.ortho_latin(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(translate(lower(replace(coalesce(text, ''), 'I', 'ı')), 'İ', 'i')) AS digest FROM documents")
def q_turkish(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.turkish_lower(F.coalesce("text", F.lit("")))).alias("digest"))


@query("SELECT doc_id, md5(concat_ws(' ', lang, source)) AS digest FROM documents")
def q_concat(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.concat_ws(" ", "lang", "source")).alias("digest"))


@query("SELECT doc_id, md5(replace(lower(coalesce(text, '')), '#', '')) AS digest FROM documents")
def q_clean_lemma(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.clean_lemma(F.coalesce("text", F.lit("")))).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN strip_accents(replace(lower(coalesce(text, '')), '#', '')) ELSE replace(lower(coalesce(text, '')), '#', '') END) AS digest FROM documents")
def q_clean_lemma_marks(spark, sf_dir):
    """The same with the branch for Arabic, which takes marks off; French stands in for Arabic."""
    lang = F.when(F.col("lang") == "fr", "ar").otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", F.md5(text.clean_lemma(F.coalesce("text", F.lit("")), lang)).alias("digest"))


@query(r"SELECT conv_id, turn, trim(split_part(trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10), 1)) AS line FROM conversations")
def q_first_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_line(F.col("text")).alias("line"))


@query(r"""SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(
  string_split(regexp_replace(trim(coalesce(text, '')), '([.!?।؟])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS p FROM documents)""")
def q_sent_split(spark, sf_dir):
    p = text.sentences(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def q_sent_rejoin(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("pos"), F.col("text").alias("part"))).alias("p"))
    return c.select("conv_id", F.md5(text.rejoined(F.col("p"))).alias("digest"))


# a normaliser of whole texts that leaves out tokens of one or two code points, so that some of what it makes isn't valid
SHORT_OUT = f"array_to_string(list_filter({TOKENS}, lambda x: length(x) > 2), ' ')"
VALID = f"trim(m) <> '' AND len({TOKENS.replace('text', 'm')}) >= 0.6 * len({TOKENS}) - 1 AND len({TOKENS.replace('text', 'm')}) <= 1.4 * len({TOKENS}) + 1"


def short_out(c):
    return F.array_join(F.filter(text.tokenize(c), lambda x: F.char_length(x) > 2), " ")


@query(f"SELECT doc_id, {VALID} AS valid FROM (SELECT doc_id, text, {SHORT_OUT} AS m FROM documents)")
def q_validity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.valid_output(F.col("text"), short_out(F.col("text"))).alias("valid"))


@query(r"SELECT doc_id, len(n)::BIGINT AS n, array_to_string(n, ' ') AS found FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?') AS n FROM documents)")
def q_regex_numbers(spark, sf_dir):
    n = text.numbers(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(n).cast("long").alias("n"), F.array_join(n, " ").alias("found"))


# --- stems ----------------------------------------------------------------------------------------


@query()
def q_porter(spark, sf_dir):
    """Porter stems of the words of English documents; each distinct word of a batch is stemmed once."""
    t = text.on_types(text.words(F.lower("text")), stemmers.porter)
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", *digest(t))


@query()
def q_stem(spark, sf_dir):
    """Types of each language and their stems."""
    types = spread(docs(spark, sf_dir).select("lang", "text")).where(F.col("lang").isin(*stemmers.BY_LANGUAGE)).select("lang", F.explode(text.words(F.lower("text"))).alias("token")).distinct()
    return types.withColumn("stem", stemmers.stem_column(F.col("token"), F.col("lang")))


@query()
def q_full_pipeline(spark, sf_dir):
    """Orthography, then stems; languages without a stemmer keep the orthographic form."""
    d = spread(docs(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "lang", text.tokenize(text.ortho(F.col("text"), "wide", F.col("lang"))).alias("t"))
    return d.select("doc_id", *digest(stemmers.stem_arrays(F.col("t"), F.col("lang"))))


@query("SELECT lang, lang IN ('da', 'de', 'en', 'es', 'fi', 'fr', 'hu', 'it', 'nl', 'no', 'pt', 'ro', 'ru', 'sv') AS has_stemmer, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def q_has_stemmer(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).withColumn("has_stemmer", F.col("lang").isin(*stemmers.BY_LANGUAGE))


# --- vocabulary -----------------------------------------------------------------------------------


def conditions(spark: SparkSession, sf_dir: str, keys: list[str], stems: bool = False) -> DataFrame:
    """keys, n, condition (raw, ortho, full), token, of the raw types. Full is ortho cut to five code points, a stemmer that SQL has too; with stems, the language's.

    Orthography and stems work on what stands between spaces, so the types of a corpus are enough.
    """
    d = spread(docs(spark, sf_dir).select("doc_id", "lang", "source", "text")).withColumn("split", F.col("doc_id") % 2)
    raw = vocabulary.types(d, list(dict.fromkeys([*keys, "lang"])), text.tokenize(F.col("text")))
    raw = raw.withColumn("ortho", text.tokenize(text.ortho(F.col("token"), "wide", F.col("lang"))))
    full = stemmers.stem_arrays(F.col("ortho"), F.col("lang")) if stems else F.transform("ortho", lambda t: F.left(t, F.lit(5)))
    return vocabulary.exploded(raw.withColumn("full", full), [*keys, "n"], raw=F.array("token"), ortho=F.col("ortho"), full=F.col("full"))


def condition_sql(keys: str) -> str:
    return f"""SELECT {keys}, 'raw' AS condition, unnest({TOKENS}) AS token FROM documents
UNION ALL SELECT {keys}, 'ortho', unnest({ORTHO_TOKENS}) FROM documents
UNION ALL SELECT {keys}, 'full', left(unnest({ORTHO_TOKENS}), 5) FROM documents"""


def vocabulary_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(DISTINCT token) FILTER (WHERE condition = 'raw')::BIGINT AS v_raw, count(DISTINCT token) FILTER (WHERE condition = 'ortho')::BIGINT AS v_ortho,
count(DISTINCT token) FILTER (WHERE condition = 'full')::BIGINT AS v_full FROM ({condition_sql(keys)}) GROUP BY {keys}"""


ALL = ["raw", "ortho", "full"]
ALL_SIZES = [f"v_{c}" for c in ALL]


@query(vocabulary_sql("lang"))
def q_vocab_size(spark, sf_dir):
    return vocabulary.vocabulary(conditions(spark, sf_dir, ["lang"]), ["lang"], ALL)


@query(f"SELECT lang, v_raw, v_ortho, round(v_raw::DOUBLE / v_ortho, 6) AS cr FROM ({vocabulary_sql('lang')})")
def q_cr(spark, sf_dir):
    v = q_vocab_size(spark, sf_dir)
    return v.select("lang", "v_raw", "v_ortho", F.round(vocabulary.ratio(F.col("v_raw"), F.col("v_ortho")), 6).alias("cr"))


@query(f"""SELECT lang, round(v_raw::DOUBLE / v_full, 6) AS cr_total, round(v_raw::DOUBLE / v_ortho, 6) AS cr_ortho, round(v_ortho::DOUBLE / v_full, 6) AS cr_morph,
round(ln(v_ortho::DOUBLE / v_full) / ln(v_raw::DOUBLE / v_full), 6) AS morph_share FROM ({vocabulary_sql('lang')})""")
def q_cr_decomposition(spark, sf_dir):
    parts = vocabulary.decomposition(F.col("v_raw"), F.col("v_ortho"), F.col("v_full"))
    return q_vocab_size(spark, sf_dir).select("lang", *[F.round(c, 6).alias(n) for n, c in parts.items()])


@query()
def q_cr_stems(spark, sf_dir):
    """The decomposition with the stems of each language as the full condition; a language without a stemmer keeps its orthographic types."""
    v = vocabulary.vocabulary(conditions(spark, sf_dir, ["lang"], stems=True), ["lang"], ALL)
    parts = vocabulary.decomposition(F.col("v_raw"), F.col("v_ortho"), F.col("v_full"))
    return v.select("lang", *ALL_SIZES, *[F.round(c, 6).alias(n) for n, c in parts.items()])


@query(f"""WITH t AS (SELECT lang, doc_id % 2 AS split, condition, token FROM ({condition_sql('lang, doc_id')})),
s AS (SELECT lang, split, round(count(DISTINCT token) FILTER (WHERE condition = 'raw')::DOUBLE / count(DISTINCT token) FILTER (WHERE condition = 'ortho'), 6) AS cr
FROM t GROUP BY GROUPING SETS ((lang, split), (lang)))
SELECT lang, max(cr) FILTER (WHERE split IS NULL) AS pooled, CASE WHEN count(cr) FILTER (WHERE split IS NOT NULL) >= 2 THEN round(max(cr) FILTER (WHERE split IS NOT NULL) - min(cr) FILTER (WHERE split IS NOT NULL), 6) END AS spread
FROM s GROUP BY lang""")
def q_cr_replicates(spark, sf_dir):
    t = conditions(spark, sf_dir, ["lang", "split"]).where("condition <> 'full'").select("lang", "split", "condition", "token").distinct()
    by_split = t.groupBy("lang", "split").agg(*[F.count(F.when(F.col("condition") == c, 1)).alias(c) for c in ("raw", "ortho")])
    pooled = t.drop("split").distinct().groupBy("lang").agg(*[F.count(F.when(F.col("condition") == c, 1)).alias(c) for c in ("raw", "ortho")]).withColumn("split", F.lit(None).cast("long"))
    s = by_split.unionByName(pooled).withColumn("cr", F.round(F.col("raw") / F.col("ortho"), 6))
    own = F.when(F.col("split").isNotNull(), F.col("cr"))
    return s.groupBy("lang").agg(F.max(F.when(F.col("split").isNull(), F.col("cr"))).alias("pooled"), F.when(F.count(own) >= 2, F.round(F.max(own) - F.min(own), 6)).alias("spread"))


@query(f"""SELECT lang, sum(len({TOKENS}))::BIGINT AS raw_tokens, sum(len({ORTHO_TOKENS}))::BIGINT AS ortho_tokens,
round(sum(len({ORTHO_TOKENS}))::DOUBLE / sum(len({TOKENS})), 6) AS ratio FROM documents GROUP BY lang""")
def q_token_totals(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", F.size(text.tokenize(F.col("text"))).alias("a"), F.size(text.tokenize(text.ortho(F.col("text"), "wide", F.col("lang")))).alias("b"))
    return d.groupBy("lang").agg(F.sum("a").alias("raw_tokens"), F.sum("b").alias("ortho_tokens"), F.round(F.sum("b") / F.sum("a"), 6).alias("ratio"))


@query(f"""WITH c AS (SELECT lang, token, count(*) FILTER (WHERE condition = 'raw') + 1e-12::DOUBLE AS cp, count(*) FILTER (WHERE condition = 'ortho') + 1e-12::DOUBLE AS cq
FROM ({condition_sql('lang')}) WHERE condition <> 'full' GROUP BY lang, token), s AS (SELECT lang, sum(cp) AS tp, sum(cq) AS tq FROM c GROUP BY lang)
SELECT c.lang, round(sum(cp / tp * ln((cp / tp) / (cq / tq))), 6) AS kl FROM c JOIN s ON c.lang = s.lang GROUP BY c.lang""")
def q_kl(spark, sf_dir):
    t = conditions(spark, sf_dir, ["lang"]).where("condition <> 'full'")
    return vocabulary.kl_divergence(t, ["lang"], "raw", "ortho", weight=F.col("n")).select("lang", F.round("kl", 6).alias("kl"))


CR_SOURCE = f"SELECT lang, source, round(v_raw::DOUBLE / v_ortho, 6) AS cr FROM ({vocabulary_sql('lang, source')})"


def cr_by_source(spark, sf_dir):
    v = vocabulary.vocabulary(conditions(spark, sf_dir, ["lang", "source"]), ["lang", "source"], ALL)
    return v.select("lang", "source", F.round(vocabulary.ratio(F.col("v_raw"), F.col("v_ortho")), 6).alias("cr"))


@query(f"SELECT lang, count(*)::BIGINT AS n, round(avg(cr), 5) AS mean, min(cr) AS least, max(cr) AS most FROM ({CR_SOURCE}) GROUP BY lang")
def q_by_script(spark, sf_dir):
    """Summary by group, the group of a variant being its language here."""
    return cr_by_source(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("cr"), 5).alias("mean"), F.min("cr").alias("least"), F.max("cr").alias("most"))


@query(f"SELECT source, round(max(cr) - min(cr), 6) AS spread, count(*)::BIGINT AS n FROM ({CR_SOURCE}) GROUP BY source HAVING count(*) >= 2")
def q_multiscript(spark, sf_dir):
    return cr_by_source(spark, sf_dir).groupBy("source").agg(F.round(F.max("cr") - F.min("cr"), 6).alias("spread"), F.count("*").alias("n")).where("n >= 2")


@query("SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY quality, toxic")
def q_label_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# --- alignment ------------------------------------------------------------------------------------


def pairs(spark, sf_dir):
    return spread(docs(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "lang", text.tokenize(F.col("text")).alias("raw"), text.tokenize(text.ortho(F.col("text"), "wide", F.col("lang"))).alias("norm"))


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n_raw, len({ORTHO_TOKENS})::BIGINT AS n_norm FROM documents")
def q_align_docs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    raw, norm = p.select("doc_id", F.size("raw").cast("long").alias("n_raw")), p.select("doc_id", F.size("norm").cast("long").alias("n_norm"))
    return raw.join(norm, "doc_id")


@query()
def q_align_ops(spark, sf_dir):
    return alignment.align(pairs(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"))


@query()
def q_anld(spark, sf_dir):
    p = alignment.align(pairs(spark, sf_dir), keys=("lang",), first_only=True)
    return alignment.anld(p, ["lang"]).withColumn("anld", F.round("anld", 6))


@query()
def q_anld_trunc(spark, sf_dir):
    p = alignment.align(pairs(spark, sf_dir), padded=False, keys=("lang",), first_only=True)
    return alignment.anld(p, ["lang"]).withColumn("anld", F.round("anld", 6))


@query(r"""SELECT DISTINCT lower(token) AS token, levenshtein(token, lower(token))::BIGINT AS distance FROM (
SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS token FROM documents)""")
def q_levenshtein(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("t")).distinct()
    return t.select(F.lower("t").alias("token"), F.levenshtein("t", F.lower("t")).cast("long").alias("distance")).distinct()
