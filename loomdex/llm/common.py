"""What the operators of this package share: the work folder, and Arrow helpers.

Intermediate results that cut lineage are Parquet tables under the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read them, so a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import operator
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: null comes last.
NULL_ID = (1 << 63) - 1

_ROOTS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
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
        _ROOTS[app] = f"{base.rstrip('/')}/loomdex-{app}"
        atexit.register(_remove_at_exit, spark, _ROOTS[app])
    return _ROOTS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended first; the folder then stays for the cluster's own cleaning
        return


_SCRATCH: list[list[str]] = []


def store(df: DataFrame, tag: str) -> str:
    """Write df to a new work table and return its path."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once: written to the work folder and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, tag))


#: Bytes of an input, as stored, for each bucket of a table; a bucket is read by one task.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000  # Spark's own limit of a table


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the bytes of df's files ask for, and as a shuffle has partitions at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_BYTES), MOST_BUCKETS) if size < 1 << 62 else 0)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """df, computed once and written in buckets of key, so that what groups or joins by key doesn't move it again."""
    spark, path, table = df.sparkSession, f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", f"loomdex_{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # found keeps what it has learnt from it, and the files stay
    return found


def settled(make: Callable[[], DataFrame], tag: str, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """What make() gives, computed once, by default as a table read again; the work tables that it stored on the way go."""
    _SCRATCH.append([])
    try:
        df = make()
    finally:
        own = _SCRATCH.pop()
    out = keep(df, tag)
    for path in own:
        remove(df.sparkSession, path)
    return out


#: The most bytes of a batch that goes to a Python worker: batches of long texts fill memory outside the JVM's heap.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a worker gives back what memory it can at the end of a task."""
    spark = df.sparkSession
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column."""
    return column.cast(pa.binary()).to_pylist()


def batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary_rows(width: int, data: np.ndarray) -> pa.Array:
    """Each row of a (n, width) byte matrix as one binary value."""
    flat = np.ascontiguousarray(data).reshape(-1)
    n = len(flat) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])


def long_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)
