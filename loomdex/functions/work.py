"""Tables that a query writes on the way: in the folder that all executors share, so that a lost one loses nothing."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application's own under ``spark.checkpoint.dir``. Where that is unset, a local session (as in
    tests) gets /tmp/checkpoints, and a cluster is refused: its executors don't share a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{base.rstrip('/')}/engine-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first; the folder then stays for the cluster's own cleaning
        return


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once: written to the work folder and read again."""
    return _written(df, f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held_for(df: DataFrame, tag: str) -> Iterator[DataFrame]:
    """As written, for what is run inside the block only: the table goes with it."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    try:
        yield _written(df, path)
    finally:
        _remove(df.sparkSession, path)
