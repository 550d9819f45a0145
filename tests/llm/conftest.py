import pytest


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, ties, copies, near copies, repeated rows."""
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    near = base.replace("alpha30", "gamma30")
    lines = "A shared line of text.\nown line %d here\nshort\nA shared  line"
    return [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, lines % 5), (6, "  " + (lines % 6) + "\r\n\n"), (7, None), (8, ""), (9, " \n\t "),
        (10, "x" * 60), (11, "é" * 60 + base), (12, "one two three"), (13, "one two three"), (14, " ".join(f"w{i}" for i in range(30_000))),
        (15, base), (15, base), (None, base), (None, near), (16, "password: hunter22 AKIA" + "Z" * 16 + " " + "0f" * 14), (17, "+1 (555) 555-0100 mail a.b@c.de ip 1.2.3.4 card 4111 1111 1111 1111"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["nd_n", "ld_id", "mx_size", "fp_id", "sd_id", "pi_row", "sc_text", "li_lang", "tx_score", "dc_hits", "n_words", "kept", "value"]
    return d.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3)).alias("source"), *[F.lit(0).alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
