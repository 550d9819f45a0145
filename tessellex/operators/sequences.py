"""What ordered lines say about those after them: the last heading above each row, for documents of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that one window holds.
PIECE = 1024
#: A section line, the start of a group of rows, the end of a row and its separator in LaTeX tables.
LATEX = {"section": r"^\\multicolumn\{\d+\}\{l\}\{\\textit\{([^}]*)\}\}", "group": r"^\\multirow\{\d+\}\{\*\}\{([^}]*)\}", "end": r"\\", "separator": "&"}
BLANK = " \t\n\x0b\x0c\r"


def last_known(df: DataFrame, keys: list[str], order: str, values: list[str], piece: int = PIECE) -> DataFrame:
    """df with each of values filled by its last value above that isn't null, within keys, by order (an integer from 0).

    Lines are cut into pieces by order; a piece is filled by itself, and gets the last values of the pieces before, which are one row each. Null
    keys are a key.
    """
    d = df.withColumn("sq_piece", F.floor(F.col(order) / piece))
    own = Window.partitionBy(*keys, "sq_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = d.groupBy(*keys, "sq_piece").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("sq_piece").rowsBetween(Window.unboundedPreceding, -1)
    above = ends.select(*[F.col(k).alias(f"sq_key{i}") for i, k in enumerate(keys)], F.col("sq_piece").alias("sq_at"), *[F.last(v, True).over(before).alias(f"sq_{v}") for v in values])
    d = d.withColumns({v: F.last(v, True).over(own) for v in values})
    same = F.col("sq_piece") == F.col("sq_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"sq_key{i}"))
    return d.join(above, same).select(*[F.coalesce(v, f"sq_{v}").alias(v) if v in values else F.col(v) for v in df.columns])


def first_group(line: Column, pattern: str) -> Column:
    """The first group of a pattern that the line matches, else null."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def table_rows(lines: DataFrame, keys: list[str], order: str, line: str, section: str = LATEX["section"], group: str = LATEX["group"], end: str = LATEX["end"], separator: str = LATEX["separator"]) -> DataFrame:
    """keys, order, section, group, cells: the rows of tables in ordered lines, each with the last section line and the last start of a group above it.

    Lines are read without space around them. A line that matches section is no row; one that matches group (both are patterns whose first
    group is the name) starts a group, and what follows may be a row. Rows end with `end`; their cells are cut at separator and stripped.
    """
    text = F.btrim(F.coalesce(F.col(line), F.lit("")), F.lit(BLANK))
    d = lines.select(*keys, order, text.alias("sq_text")).withColumn("section", first_group(F.col("sq_text"), section))
    d = d.withColumn("group", F.when(F.col("section").isNull(), first_group(F.col("sq_text"), group)))
    rest = F.when(F.col("group").isNotNull(), F.btrim(F.regexp_replace("sq_text", group, ""), F.lit(BLANK))).otherwise(F.col("sq_text"))
    d = d.withColumn("sq_row", F.when(F.col("section").isNull() & F.endswith(rest, F.lit(end)), rest))
    d = last_known(d, keys, order, ["section", "group"]).where("sq_row is not null")
    body = F.left("sq_row", F.char_length("sq_row") - len(end))
    cells = F.transform(F.split(body, F.lit("\\Q" + separator + "\\E"), -1), lambda c: F.btrim(c, F.lit(BLANK)))
    return d.select(*keys, order, "section", "group", cells.alias("cells"))
