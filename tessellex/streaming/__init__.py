"""An addition to the evaluation: the same vocabulary sizes over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.functions.text import tokenize


def streaming_vocabulary(stream: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, token, n as a streaming aggregate in update mode: each new type is a new group; types are counted where it is read.

    The state holds one row a type and key. With a watermark on the stream and a window among the keys, old windows go.
    """
    tokens = stream.select(*keys, F.explode(tokenize(F.col(text))).alias("token"))
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))
