"""Flat tables of nested results: a row for each combination of keys, a column for each value, whatever its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of an evaluation's results: the keys of the nesting, and columns with their places below the last key.
INTERVAL = ("ci95_lo", "ci95_hi")
MCNEMAR = {"mcnemar_statistic": "$.mcnemar.statistic", "mcnemar_p": "$.mcnemar.p", "mcnemar_exact": "$.mcnemar.exact"}
SHAPES: dict[str, tuple[list[str], dict[str, str]]] = {
    "intrinsic": (["unit"], {c: f"$.{c}" for c in ("n", "CR", "VRG", "IRS", "AES", "ANLD", "KL")}),
    "sweep": (["unit", "beta"], {"AES": "$"}),
    "decomposition": (["lang"], {c: f"$.{c}" for c in ("V_raw", "V_ortho", "V_full", "CR_total", "CR_ortho", "CR_morph", "morph_share")}),
    "downstream": (["unit", "classifier", "seed"], {**{c: f"$.{c}" for c in ("n_folds", "delta_mean", "delta_sd", "d_z", "wilcoxon_p")}, **{f"delta_{c}": f"$.delta_ci95[{i}]" for i, c in enumerate(INTERVAL)}, **MCNEMAR}),
    "retrieval": (["lang", "condition", "params"], {c: f"$.{c}" for c in ("R@1", "R@10", "MRR@10", "mean_rank")}),
    "comparison": (["lang", "comparison"], {"delta": "$.delta", **{f"delta_{c}": f"$.ci95[{i}]" for i, c in enumerate(INTERVAL)}, **MCNEMAR}),
    "predictiveness": (["target", "dimension"], {c: f"$.{c}" for c in ("rho", "p", "p_holm", "n")}),
}


def flatten_json(df: DataFrame, column: str, keys: list[str], fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, keys and fields (strings, null where absent) of the nested objects in a column of JSON texts."""
    schema: T.DataType = T.StringType()
    for _ in keys:
        schema = T.MapType(T.StringType(), schema)
    out = df.select(*keep, F.from_json(column, schema).alias("leaf"))
    done: list[str] = []
    for key in keys:
        out = out.select(*keep, *done, F.explode("leaf").alias(key, "leaf"))
        done.append(key)
    return out.select(*keep, *keys, *[(F.col("leaf") if path == "$" else F.get_json_object("leaf", _quoted(path))).alias(name) for name, path in fields.items()])


def _quoted(path: str) -> str:
    """Names with signs other than letters, digits and underscores in brackets, as JSON paths need them."""
    parts = path.removeprefix("$.").split(".")
    return "$" + "".join(f".{p}" if p.replace("[", "").replace("]", "").replace("_", "").isalnum() else f"['{p}']" for p in parts)


def result_table(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """The table of a file of results by the name of its shape."""
    keys, fields = SHAPES[shape]
    return flatten_json(spark.read.option("wholetext", True).text(path), "value", keys, fields)
