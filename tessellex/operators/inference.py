"""Hooks for models that Spark doesn't have: encoders, normalisers and classifiers of any library, as functions of lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.functions.text import valid_output

from . import ranking


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64, out: str = "vector") -> DataFrame:
    """df with out, an array<double> for each text; null texts are encoded as empty.

    load runs once a task and returns the model as a function of a list of at most batch texts.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return df.withColumn(out, run(F.col(text)))


def by_length(df: DataFrame, text: str, batch: int) -> DataFrame:
    """df with batch: numbers of batches of so many rows, the longest texts first, so that a batch holds texts of like length."""
    d = df.withColumns({"bl_size": -F.char_length(F.coalesce(text, F.lit(""))), "bl_tie": F.xxhash64(text)})
    ranges = ranking.range_of(F.col("bl_size"), ranking.bounds(d, "bl_size", "bl_tie"), F.col("bl_tie"))
    return ranking.positions(d, [], ranges, ["bl_size", "bl_tie", text], "bl_at").withColumn("batch", F.floor(F.col("bl_at") / batch)).drop("bl_size", "bl_tie", "bl_at")


def normalise(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[str | None]]], batch: int = 32, out: str = "norm") -> DataFrame:
    """df with out and used (made, retry or input): what a normaliser makes of each text.

    Distinct texts are made once, in batches of like length. What isn't valid (valid_output), or raises, is made once
    more by itself; where that fails, too, the input stays. Null texts stay null.
    """
    distinct = df.where(F.col(text).isNotNull()).select(F.col(text).alias("nm_text")).distinct()
    ordered = by_length(distinct, "nm_text", batch)

    def attempts(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def made(texts: list[str]) -> list[str | None]:
            try:
                return model(texts)
            except Exception:  # noqa: BLE001  whatever a model raises, the text falls back
                return [None] * len(texts)

        for g in groups:
            for _, rows in g.groupby("batch", sort=False):
                texts = rows["nm_text"].tolist()
                yield pd.DataFrame({"nm_text": texts, "nm_first": made(texts)})

    def again(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for g in groups:
            second = []
            for t in g["nm_text"]:
                try:
                    second.append(model([t])[0])
                except Exception:  # noqa: BLE001
                    second.append(None)
            yield g.assign(nm_second=second)

    # a batch is in one partition, and there stands together
    first = ordered.repartition("batch").sortWithinPartitions("batch").mapInPandas(attempts, "nm_text string, nm_first string")
    ok = lambda c: F.coalesce(valid_output(F.col("nm_text"), F.col(c)), F.lit(False))
    first = first.withColumn("nm_ok", ok("nm_first"))
    retried = first.where(~F.col("nm_ok")).mapInPandas(again, "nm_text string, nm_first string, nm_ok boolean, nm_second string")
    good = first.where("nm_ok").select("nm_text", F.col("nm_first").alias(out), F.lit("made").alias("used"))
    rest = retried.select("nm_text", F.when(ok("nm_second"), F.col("nm_second")).otherwise(F.col("nm_text")).alias(out), F.when(ok("nm_second"), F.lit("retry")).otherwise(F.lit("input")).alias("used"))
    return df.join(good.unionByName(rest), F.col(text) == F.col("nm_text"), "left").drop("nm_text")
