"""Scratch tables: what a plan would compute more than once, written where all executors can read it."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of scratch tables by session, in the order in which they were made.
_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Without that setting, only a session whose executors are threads of the driver gets a folder of its own machine. The
    folder goes at the end of the scratch() around it, or when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(app, tempfile.mkdtemp(prefix="tessellex-"))
    path = f"{base.rstrip('/')}/tessellex-{app}/{uuid.uuid4().hex}"
    _tables(spark).append(path)
    return path


def release(df: DataFrame) -> None:
    """Removes the scratch table that df reads; nothing may read it any more."""
    files = df._jdf.inputFiles()
    if len(files):
        made = _tables(df.sparkSession)
        path = files[0].rpartition("/")[0]
        (at,) = (i for i, p in enumerate(made) if path.endswith(p.rpartition("/")[2]))
        gone = [made.pop(at)]
        _remove(df.sparkSession, gone, 0)


def _tables(spark: SparkSession) -> list[str]:
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_remove, spark, _made[app], 0)
    return _made[app]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators made inside, so that queries of a long session don't pile up. Results must have been written by then."""
    made = _tables(spark)
    before = len(made)
    try:
        yield
    finally:
        _remove(spark, made, before)


def _remove(spark: SparkSession, made: list[str], first: int) -> None:
    for path in made[first:]:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended before
            pass
    del made[first:]


def written(df: DataFrame) -> str:
    """The folder of a new scratch table of df's rows."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: a lost executor costs no more than a task, and nothing is computed twice."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
