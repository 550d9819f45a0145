import hashlib
import math
from pathlib import Path

import numpy as np
import pandas as pd

DATA = Path("/root/testdata")


def cell(v):
    if pd.isna(v):
        return "None"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def same(a, b):
    """Whether two pandas frames hold the same rows, columns by name and rows in any order."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda x: sorted(str([*map(cell, r)]) for r in x[columns].itertuples(index=False, name=None))
    assert rows(a) == rows(b)


def interval(items, values, n_boot=10_000, seed=12345):
    """The 95 % interval of the mean whose replicates draw each item as often as a hash of both says (Poisson of mean one)."""
    cuts = np.cumsum([1 / math.factorial(i) for i in range(14)]) / math.e
    step = np.arange(1, n_boot // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums, counts = np.zeros(n_boot), np.zeros(n_boot)
    for item, v in zip(items, values, strict=True):
        z = step + np.uint64(int(hashlib.md5(f"{seed}:{item}".encode()).hexdigest()[:16], 16))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        u = np.stack((z & np.uint64(0xFFFFFFFF), z >> np.uint64(32)), axis=1).ravel() / 2.0**32
        n = (u[None] >= cuts[:, None]).sum(axis=0)
        sums += n * v
        counts += n
    means = sums[counts > 0] / counts[counts > 0]
    return tuple(np.percentile(means, [2.5, 97.5]).tolist())
