"""What the operators on vectors share: which rows they read, and their vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector isn't null and has finite entries only."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(F.forall(F.col(vector).cast("array<double>"), real))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a batch as float64; they must have one length, width where that is given."""
    sizes = np.diff(np.asarray(column.offsets.to_numpy(), np.int64))
    if width is None:
        width = int(sizes[0]) if len(sizes) else 0
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} and of {int(sizes[sizes != width][0])} entries in one table")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)
