"""Filters, joins and reporting relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellex.functions import text
from tessellex.operators import ranking, sequences
from tessellex.sources import lookup, parse_conllu, table

from . import query
from .texts import TOKENS


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, lang, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def q_corpus_splits(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test").alias("split"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT lang FROM documents")
def q_langs(spark, sf_dir):
    return docs(spark, sf_dir).select("lang").distinct()


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY text")
def q_dedup_first(spark, sf_dir):
    """Equal texts once, by their first id; only digests are shuffled."""
    return docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_limit(spark, sf_dir):
    """An ordered prefix (a top-k report)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, count(*) OVER () AS n FROM customer)
SELECT pos::BIGINT AS pos, c_custkey FROM n WHERE pos IN (SELECT floor(i * (n2 - 1) / 99.0::DOUBLE) FROM (SELECT unnest(range(0, 100)) AS i), (SELECT count(*) AS n2 FROM customer))""")
def q_systematic_sample(spark, sf_dir):
    """Evenly spaced rows (a sampling operator): the positions of linspace(0, n - 1, 100), cut to integers."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = c.count()
    numbered = ranking.positions(c, [], ranking.range_of(F.col("c_custkey"), ranking.bounds(c, "c_custkey")), ["c_custkey"])
    at = spark.range(100).select(F.floor(F.col("id") * (n - 1) / F.lit(99.0)).alias("pos")).distinct()
    return numbered.join(F.broadcast(at), "pos").select("pos", "c_custkey")


CACHE = "(SELECT text AS raw, translate(text, 'aeiou', 'AEIOU') AS norm FROM documents GROUP BY text)"


@query(f"SELECT d.doc_id, md5(c.norm) AS digest FROM documents d LEFT JOIN {CACHE} c ON d.text = c.raw")
def q_lookup_norm(spark, sf_dir):
    """Texts joined to a cache of normalised texts by a digest of the raw text; a text that it lacks would be an error."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    cache = d.select(F.col("text").alias("raw"), F.translate("text", "aeiou", "AEIOU").alias("norm")).distinct().withColumnRenamed("raw", "text")
    return lookup(d, cache, "text", "norm").select("doc_id", F.md5("norm").alias("digest"))


@query("SELECT d.doc_id, coalesce(nullif(a.quality, 0), b.toxic, -1)::INT AS value FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id")
def q_coalesce_lookup(spark, sf_dir):
    """The value of one cache where it has one, else of another, else a default."""
    la = table(spark, sf_dir, "labels")
    d = docs(spark, sf_dir).select("doc_id").join(la.select("doc_id", F.nullif("quality", F.lit(0)).alias("a")), "doc_id", "left")
    return d.join(la.select("doc_id", F.col("toxic").alias("b")), "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.lit(-1)).cast("int").alias("value"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_key_intersect(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_missing_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT n_regionkey, count(*)::BIGINT AS cells, (count(*) FILTER (WHERE abs(a - b) <= 0.05 * abs(a)))::BIGINT AS matches FROM (
SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS a, median(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_regionkey""")
def q_tolerance_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("a"), F.percentile("c_acctbal", F.lit(0.5)).alias("b"))
    return p.groupBy("n_regionkey").agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 0.05 * F.abs("a")).alias("matches"))


@query("""SELECT label, round(max(abs(a - b)), 6) AS worst, (count(*) FILTER (WHERE abs(a - b) > 0.05))::BIGINT AS apart FROM (SELECT e.label, e.vec_id, list_dot_product(e.v, e.v) AS a, e.n AS b FROM (
SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, avg(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) OVER (PARTITION BY label) AS n FROM embeddings) e) GROUP BY label""")
def q_package_check(spark, sf_dir):
    """A figure of each unit against a replica made another way (here its squared norm against its label's mean): the worst difference and how many are apart."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("a"))
    x = e.join(e.groupBy("label").agg(F.avg("a").alias("b")), "label")
    return x.groupBy("label").agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("worst"), F.count_if(F.abs(F.col("a") - F.col("b")) > 0.05).alias("apart"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS label FROM labels WHERE quality IS NOT NULL")
def q_label_decode(spark, sf_dir):
    names = F.create_map(F.lit(0), F.lit("poor"), F.lit(1), F.lit("good"))
    return table(spark, sf_dir, "labels").dropna(subset=["quality"]).select("doc_id", F.element_at(names, F.col("quality")).alias("label"))


SENTENCES = """SELECT doc_id, line, regexp_extract_all(t, '[^ ]+') AS s FROM (SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""


def sentences(spark, sf_dir):
    """doc_id, line, tokens: each line of each document as a treebank block, read back by the treebank parser."""
    line = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "t"))
    t = F.regexp_extract_all("t", F.lit("[^ ]+"), F.lit(0))
    rows = F.transform(t, lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.lower(F.replace(x, F.lit("-"), F.lit("_"))), F.lit("X")))
    block = F.array_join(F.concat(F.array(F.lit("# text = x")), rows, F.array(F.lit("1-2\tx\tx\tX"))), "\n")
    return parse_conllu(line.select("doc_id", "line", block.alias("value")), "value", keep=["doc_id", "line"])


def filtered(spark, sf_dir):
    ok = F.size("tokens").between(6, 25) & F.forall("tokens", lambda x: ~F.contains(x.getField("lemma"), F.lit("_")))
    return sentences(spark, sf_dir).where(ok).select("doc_id", F.col("line").cast("long").alias("line"), F.size("tokens").cast("long").alias("n_tokens"))


FILTERED = f"SELECT doc_id, line::BIGINT AS line, len(s)::BIGINT AS n_tokens FROM ({SENTENCES}) WHERE len(s) BETWEEN 6 AND 25 AND len(list_filter(s, lambda x: contains(x, '-') OR contains(x, '_'))) = 0"


@query(FILTERED)
def q_conll_filter(spark, sf_dir):
    """Sentences of 6 to 25 tokens whose lemmas hold no underscore."""
    return filtered(spark, sf_dir)


@query(f"SELECT CASE WHEN k <= 5 THEN 'example' ELSE 'held out' END AS part, k, doc_id, line FROM (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS k FROM ({FILTERED})) WHERE k <= 65")
def q_conll_slices(spark, sf_dir):
    """Of these the first five as examples and the next sixty as held out (a prefix by its meaning)."""
    f = filtered(spark, sf_dir)
    first = ranking.positions(f.orderBy("doc_id", "line").limit(65), [], F.lit(0), ["doc_id", "line"])
    return first.select(F.when(F.col("pos") < 5, "example").otherwise("held out").alias("part"), (F.col("pos") + 1).alias("k"), "doc_id", "line")


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def q_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


NATIONS = "SELECT c_nationkey AS nation, round(avg(c_acctbal), 4) AS bal, count(*)::BIGINT AS n FROM customer GROUP BY c_nationkey"


def nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 4).alias("bal"), F.count("*").alias("n"))


@query(f"SELECT nation, row_number() OVER (ORDER BY bal DESC, nation)::INT AS by_bal, row_number() OVER (ORDER BY n, nation)::INT AS by_n FROM ({NATIONS})")
def q_rank_matrix(spark, sf_dir):
    """Ranks of each column, each in its own direction. The windows are over the few rows of a report."""
    return nations(spark, sf_dir).select("nation", F.row_number().over(Window.orderBy(F.desc("bal"), "nation")).alias("by_bal"), F.row_number().over(Window.orderBy("n", "nation")).alias("by_n"))


@query(f"SELECT nation, (row_number() OVER (ORDER BY bal DESC, nation) - row_number() OVER (ORDER BY n DESC, nation))::INT AS shift FROM ({NATIONS})")
def q_rank_shift(spark, sf_dir):
    a, b = (F.row_number().over(Window.orderBy(F.desc(c), "nation")) for c in ("bal", "n"))
    return nations(spark, sf_dir).select("nation", (a - b).alias("shift"))


@query(f"SELECT nation, ((row_number() OVER (ORDER BY nation) - 1) // ((count(*) OVER () + 2) // 3))::INT AS part FROM ({NATIONS})")
def q_columns3(spark, sf_dir):
    """The column of a three-column layout."""
    k = F.row_number().over(Window.orderBy("nation")) - 1
    return nations(spark, sf_dir).select("nation", F.floor(k / F.floor((F.count("*").over(Window.partitionBy()) + 2) / 3)).cast("int").alias("part"))


@query(f"SELECT max(bal) AS most, arg_max(nation, (bal, -nation)) AS argmax, min(bal) AS least, arg_min(nation, (bal, nation)) AS argmin FROM ({NATIONS})".replace("arg_max(nation, (bal, -nation))", f"(SELECT nation FROM ({NATIONS}) ORDER BY bal DESC, nation LIMIT 1)").replace("arg_min(nation, (bal, nation))", f"(SELECT nation FROM ({NATIONS}) ORDER BY bal, nation LIMIT 1)"))
def q_extremes(spark, sf_dir):
    return nations(spark, sf_dir).agg(F.max("bal").alias("most"), F.max_by("nation", F.struct("bal", -F.col("nation"))).alias("argmax"), F.min("bal").alias("least"), F.min_by("nation", F.struct("bal", "nation")).alias("argmin"))


@query("SELECT l_returnflag, round(avg(l_discount) FILTER (WHERE l_linestatus = 'O') - avg(l_discount) FILTER (WHERE l_linestatus = 'F'), 6) AS gap FROM lineitem GROUP BY l_returnflag")
def q_pivot_gap(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_discount"))
    return p.select("l_returnflag", F.round(F.col("O") - F.col("F"), 6).alias("gap"))


YEARS = "SELECT o_orderpriority AS unit, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY ALL"


def deltas(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return y.alias("a").join(y.alias("b"), (F.col("a.unit") == F.col("b.unit")) & (F.col("b.y") == F.col("a.y") + 1)).select(F.col("a.unit").alias("unit"), F.col("a.y").alias("y"), F.round(F.col("b.v") - F.col("a.v"), 4).alias("d"))


DELTAS = f"SELECT a.unit, a.y, round(b.v - a.v, 4) AS d FROM ({YEARS}) a JOIN ({YEARS}) b ON a.unit = b.unit AND b.y = a.y + 1"


@query(f"SELECT unit, round(avg(d), 3) AS mean, min(d) AS least, max(d) AS most, (count(*) FILTER (WHERE d > 0))::BIGINT AS n_up FROM ({DELTAS}) GROUP BY unit")
def q_dsp_summary(spark, sf_dir):
    return deltas(spark, sf_dir).groupBy("unit").agg(F.round(F.avg("d"), 3).alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"), F.count_if(F.col("d") > 0).alias("n_up"))


@query(f"SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN d - 1000 > 0 THEN 'better' WHEN d + 1000 < 0 THEN 'worse' ELSE 'same' END AS verdict FROM ({DELTAS})) GROUP BY verdict")
def q_ci_verdict(spark, sf_dir):
    """Better, worse or same by the sign of an interval, here of 1000 to either side."""
    v = F.when(F.col("d") - 1000 > 0, "better").when(F.col("d") + 1000 < 0, "worse").otherwise("same")
    return deltas(spark, sf_dir).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"SELECT bool_and(abs(d) < 1e6) AS all_small, bool_or(d > 0) AS any_up, (count(*) FILTER (WHERE d > 0)) >= 3 AS three_up FROM ({DELTAS})")
def q_headlines(spark, sf_dir):
    d = F.col("d")
    return deltas(spark, sf_dir).agg(F.bool_and(F.abs(d) < 1e6).alias("all_small"), F.bool_or(d > 0).alias("any_up"), (F.count_if(d > 0) >= 3).alias("three_up"))


@query("SELECT event_id, 'k' AS key, (props->>'$.k')::BIGINT AS value FROM events UNION ALL SELECT event_id, 'value', round(value)::BIGINT FROM events")
def q_flatten(spark, sf_dir):
    """Nested results to rows of key and value."""
    e = table(spark, sf_dir, "events")
    m = F.create_map(F.lit("k"), F.from_json("props", "k bigint")["k"], F.lit("value"), F.round("value").cast("long"))
    return e.select("event_id", F.explode(m).alias("key", "value"))


@query("SELECT o_orderkey, abs(round(o_totalprice, 1) - o_totalprice) <= 0.05 + 1e-12 AS traced FROM orders")
def q_round_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.rounds_to(F.round("o_totalprice", 1), F.col("o_totalprice"), 1).alias("traced"))


@query(r"""WITH n AS (SELECT DISTINCT x FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?')) AS x FROM documents) WHERE length(x) <= 3)
SELECT n.x AS printed, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity::DOUBLE = n.x::DOUBLE) AS traced FROM n""")
def q_prose_numbers(spark, sf_dir):
    """Numbers of at most three characters in texts, and whether a column of results has them."""
    n = docs(spark, sf_dir).select(F.explode(text.numbers(F.col("text"))).alias("printed")).where(F.char_length("printed") <= 3).distinct()
    values = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("value")).distinct().withColumn("traced", F.lit(True))
    return n.withColumn("value", F.col("printed").cast("double")).join(values, "value", "left").select("printed", F.coalesce("traced", F.lit(False)).alias("traced"))


#: In documents a line of at most four words is a section, and a capitalised word starts a group; a row ends with a full stop.
PROSE = {"section": r"^(\S+(?: \S+){0,3})$", "group": r"^([A-Z][a-z]+) ", "end": ".", "separator": ","}


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS line, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
s AS (SELECT *, CASE WHEN regexp_matches(t, '{PROSE["section"]}') THEN regexp_extract(t, '{PROSE["section"]}', 1) END AS section, CASE WHEN NOT regexp_matches(t, '{PROSE["section"]}') AND regexp_matches(t, '{PROSE["group"]}') THEN regexp_extract(t, '{PROSE["group"]}', 1) END AS g FROM l),
r AS (SELECT doc_id, line, last_value(section IGNORE NULLS) OVER w AS section, last_value(g IGNORE NULLS) OVER w AS "group", CASE WHEN section IS NULL THEN CASE WHEN g IS NULL THEN t ELSE regexp_replace(t, '{PROSE["group"]}', '') END END AS rest FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT doc_id, line, section, "group", unnest(string_split(left(rest, length(rest) - 1), ',')) AS cell, generate_subscripts(string_split(left(rest, length(rest) - 1), ','), 1) - 1 AS col FROM r WHERE rest LIKE '%.')
SELECT doc_id, line::BIGINT AS line, section, "group", col::INT AS col, unnest(regexp_extract_all(cell, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?')) AS printed FROM c""")
def q_table_numbers(spark, sf_dir):
    """The numbers printed in rows, with the row's place, its column, and the section and group that it stands under."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "t")).withColumn("line", F.col("line").cast("long"))
    rows = sequences.table_rows(lines, ["doc_id"], "line", "t", **PROSE).select("doc_id", "line", "section", "group", F.posexplode("cells").alias("col", "cell"))
    return rows.select("doc_id", "line", "section", "group", "col", F.explode(text.numbers(F.col("cell"))).alias("printed"))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, sha256(text) AS h FROM documents),
b AS (SELECT pos // 1000 AS pos, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h FROM e GROUP BY pos // 1000)
SELECT CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, chr(10) ORDER BY pos)) END AS digest FROM b""")
def q_text_digest(spark, sf_dir):
    """One digest of the corpus in order. (The SQL has two levels of blocks, enough for a million documents.)"""
    from tessellex.sources import text_digest

    return text_digest(docs(spark, sf_dir), "doc_id", "text")


@query(f"SELECT lang, round(corr(n, w), 6) AS r FROM (SELECT lang, length(text)::DOUBLE AS n, len({TOKENS})::DOUBLE AS w FROM documents) GROUP BY lang")
def q_length_corr(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", F.char_length("text").cast("double").alias("n"), F.size(text.tokenize(F.col("text"))).cast("double").alias("w"))
    return d.groupBy("lang").agg(F.round(F.corr("n", "w"), 6).alias("r"))

