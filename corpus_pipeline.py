"""The corpus pipeline: STAGES over documents, each reading what its predecessor wrote.

Every stage but the last returns the columns of documents, whatever they are, with clean documents untouched. Nulls,
empty tables and extra columns are handled as the operators' docstrings say; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.llm.common import materialize, table
from tessellex.llm.decontaminate import find_items
from tessellex.llm.language_id import fold, identify, learn
from tessellex.llm.line_dedup import dedup_lines
from tessellex.llm.mixing import mix_sources
from tessellex.llm.near_dedup import near_duplicates

#: Documents whose union of shingles they share to this percentage are near duplicates.
NEAR_PERCENT = 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but text in one struct, so that no name clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("cp_rest"))


def _unpacked(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of like, those in new with their new values."""
    new = {"text": F.col("text"), **new}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"cp_rest.`{c}`").alias(c) for c in like.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts and texts without a letter. A null lang becomes the predicted one, and stays null if nothing was learned."""
    model = learn(docs.where(fold(docs, 3) != 1))
    judged = identify(_packed(docs), model, keep=["doc_id", "text", "cp_rest"]).where("li_lettered")
    return _unpacked(judged, docs, lang=F.coalesce(F.col("cp_rest.lang"), F.when(F.col("li_entropy").isNotNull(), F.col("li_lang"))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines. A document that loses all its lines goes; n_chars follows the text where that column exists."""
    kept = dedup_lines(_packed(docs), keep=("cp_rest",)).where((F.col("ld_n_dropped") == 0) | F.col("ld_text").rlike(r"[^\x20\x09-\x0D]"))
    return _unpacked(kept, docs, text=F.col("ld_text"), n_chars=F.char_length("ld_text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: of the smallest doc_id, and there of the least hash of its text.

    Of rows that repeat that doc_id and text one stays. Rows without a doc_id or without words belong to no group and stay.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT, keep_row=True)
    key = [F.col("doc_id").alias("cp_id"), F.col("nd_row").alias("cp_row")]
    gone = judged.where(~F.col("nd_first")).select(*key).distinct()
    same = lambda marks: (docs["doc_id"] == marks["cp_id"]) & (F.xxhash64(docs["text"]) == marks["cp_row"])
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = judged.where("nd_first and doc_id is not null and nd_n > 0").groupBy(*key).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return kept
    repeated = materialize(repeated)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(repeated, same(repeated), "left_semi").select(row.alias("cp_rest")).groupBy("cp_rest.doc_id", "cp_rest.text").agg(F.min_by("cp_rest", F.to_json("cp_rest")).alias("cp_rest"))
    return kept.join(repeated, same(repeated), "left_anti").unionByName(once.select("cp_rest.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    found = find_items(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["doc_id", "text", "cp_rest"])
    return _unpacked(found.where(F.size("dc_hits") == 0), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that the mix takes: doc_id, source, text, size, target (of its source) and taken (words)."""
    mixed = mix_sources(docs, keep=("text",)).where("mx_taken > 0")
    return mixed.select("doc_id", "source", "text", F.col("mx_size").alias("size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the language model that run() uses; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
