"""Tables, text corpora and treebanks; sinks with provenance."""

from __future__ import annotations

import platform
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many partitions as there are cores, for what costs much more than its shuffle; a scan that has them already isn't touched.

    A file of one row group is one task however many partitions it is cut into, so partitions with rows are counted, from
    the footers. Scans of more files than cores aren't even counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:  # the names stay in the JVM
        return df
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if filled >= cores else df.repartition(cores)


def read_lines(spark: SparkSession, paths: dict[str, str], limit: int | None = None) -> DataFrame:
    """split, line, text: line-aligned corpora, a file a split in the order given; lines are numbered from 0 within a split.

    Files are read in pieces, whatever their size: a line's number is its place in its piece and the lines of the pieces
    before. With limit, the first lines of all splits together stay, so the first splits come whole.
    """
    parts = []
    for i, (split, path) in enumerate(paths.items()):
        lines = spark.read.text(path).select(F.lit(i).alias("order"), F.lit(split).alias("split"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
        parts.append(lines)
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    pieces = lines.groupBy("order", "file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    by_split = Window.partitionBy("order").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(by_split), F.lit(0))).drop("n")
    out = lines.join(pieces, ["order", "file", "block"]).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    if limit is not None:
        sizes = {r["order"]: r["n"] for r in lines.groupBy("order").agg(F.count("*").alias("n")).collect()}  # one row a split
        left, kept = limit, F.lit(False)
        for i in range(len(paths)):
            kept = F.when(F.col("order") == i, F.col("line") < max(0, left)).otherwise(kept)
            left -= sizes.get(i, 0)
        out = out.where(kept)
    return out.select("split", "line", "text")


def read_nli(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """line, premise, hypothesis, label of a file of JSON lines; with limit, its first lines."""
    rows = read_lines(spark, {"nli": path}, limit)
    fields = F.from_json("text", "premise string, hypothesis string, label int")
    return rows.select("line", fields.alias("x")).select("line", "x.*")


def aligned_sheets(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Two sheets of the same rows, joined by their index. A row that only one of them has is an error, raised where the result is read."""
    both = a.withColumn("sheet_a", F.lit(True)).join(b.withColumn("sheet_b", F.lit(True)), index, "full")
    whole = F.when(F.col("sheet_a").isNull() | F.col("sheet_b").isNull(), F.raise_error(F.lit("the sheets hold different rows")).cast("boolean")).otherwise(F.lit(True))
    return both.where(whole).drop("sheet_a", "sheet_b")


def lookup(df: DataFrame, cache: DataFrame, raw: str, norm: str) -> DataFrame:
    """df with norm, which cache (raw, norm) has for each raw text. A text that it lacks is an error, raised where the result is read.

    Texts are joined by a digest; the cache is one row a distinct text.
    """
    digest = F.sha2(raw, 256).alias("lookup_key")
    made = cache.select(digest, F.col(norm).alias("lookup_norm"), F.lit(True).alias("lookup_known"))
    out = df.withColumn("lookup_key", F.sha2(raw, 256)).join(made, "lookup_key", "left")
    found = F.when(F.col("lookup_known"), F.col("lookup_norm")).otherwise(F.raise_error(F.lit("a text has no normalised form in the cache")).cast("string"))
    return out.withColumn(norm, found).drop("lookup_key", "lookup_norm", "lookup_known")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of results with a header, all values strings, absent ones null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, folder: str, name: str, about: str) -> None:
    """One CSV file folder/name of a report's few rows, and a row about it in folder/INDEX (name, columns, rows, about)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    row = [(name, ",".join(df.columns), df.count(), about)]
    df.sparkSession.createDataFrame(row, "name string, columns string, n_rows long, about string").coalesce(1).write.mode("append").option("header", True).csv(f"{folder}/INDEX")


def log_values(df: DataFrame, figure: str, item: str, value: str, source: str, path: str) -> None:
    """Appends (figure, item, value, source) of each row: the values that a figure shows, for later checks."""
    df.select(F.lit(figure).alias("figure"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"), F.lit(source).alias("source")).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    """A fitted MLlib model, overwriting an older one; load it with its class's load()."""
    model.write().overwrite().save(path)


class TextSets:
    """Text sets by name: each name is a function that returns id and text."""

    def __init__(self, **sets: Callable[[], DataFrame]) -> None:
        self.sets = sets

    def __call__(self, name: str, limit: int | None = None) -> DataFrame:
        if name not in self.sets:
            raise KeyError(f"no text set {name}: there are {', '.join(sorted(self.sets))}")
        df = self.sets[name]().select("id", "text")
        return df if limit is None else df.orderBy("id").limit(limit)


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """text, tokens (array of form, lemma, upos) of each sentence; multiword and empty nodes are left out."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return parse_conllu(blocks, "value")


def parse_conllu(blocks: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    lines = F.split(column, "\n")
    fields = F.transform(F.filter(lines, lambda x: x.rlike(r"^[0-9]+\t")), lambda x: F.split(x, "\t"))
    tokens = F.transform(fields, lambda f: F.struct(F.get(f, 1).alias("form"), F.replace(F.lower(F.get(f, 2)), F.lit("#"), F.lit("")).alias("lemma"), F.get(f, 3).alias("upos")))
    text = F.regexp_extract(column, r"(?m)^# text = (.*)$", 1)
    return blocks.select(*(keep or []), text.alias("text"), tokens.alias("tokens"))


def write_once(df: DataFrame, path: str, source: str) -> None:
    """Writes df with its provenance (source, time, versions, arguments), unless the path exists; the commit protocol makes it all or nothing."""
    saved = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    versions = f"python {platform.python_version()}, spark {df.sparkSession.version}"
    df.withColumns({"_source": F.lit(source), "_saved": F.lit(saved), "_versions": F.lit(versions), "_argv": F.lit(" ".join(sys.argv))}).write.mode("ignore").parquet(path)


def remaining(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: the rows of work without finished keys."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def text_digest(df: DataFrame, order: str, text: str, block: int = 1000) -> DataFrame:
    """digest: SHA-256 over the SHA-256 of the texts in order, by blocks of rows, and of the blocks' digests in turn, until one is left."""
    from tessellex.operators import ranking

    ranges = ranking.range_of(F.col(order), ranking.bounds(df, order))
    n = df.count()
    each = ranking.positions(df.select(order, F.sha2(text, 256).alias("h")), [], ranges, [order]).select("pos", "h")
    while True:
        rows = each.groupBy(F.floor(F.col("pos") / block).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("r"))
        each = rows.select("pos", F.sha2(F.array_join(F.transform("r", lambda r: r.getField("h")), "\n"), 256).alias("h"))
        n = -(-n // block)
        if n <= 1:
            return each.select(F.col("h").alias("digest"))
