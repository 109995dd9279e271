"""Watching: events to debounced batches, and document state that grows by what each look at a folder saw."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed value: the schema of Spark's binary file source.
FILES = "path string, modificationTime timestamp, length long, content binary"


def sessions(events: DataFrame, key: str, ts: str, quiet: float, ceiling: float | None = None, tie: str | None = None) -> DataFrame:
    """key, session, started, ended, events: batches closed by ``quiet`` seconds without an event; with a ceiling a
    batch is also cut each so many seconds after it began. Events of one instant are one batch in any order; tie: a
    column that orders them all the same."""
    w = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    rows = events.withColumn("_us", micros).withColumn("_new", F.when(gap.isNull() | (gap > int(quiet * 1e6)), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    if ceiling is not None:
        begun = F.min("_us").over(Window.partitionBy(key, "session"))
        rows = rows.withColumn("part", F.floor((F.col("_us") - begun) / int(ceiling * 1e6)))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    by = rows.groupBy(key, "session", "part").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
    return by.withColumn("session", F.col("session").cast("long")).withColumn("part", F.col("part").cast("long"))


def streamed_sessions(events: DataFrame, key: str, ts: str, quiet: str, late: str) -> DataFrame:
    """The same batches over a stream, final once ``late`` has passed."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    by = timed.groupBy(key, F.session_window("_ts", quiet).alias("w")).agg(F.count("*").alias("events"))
    return by.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "events")


def watch_folder(spark: SparkSession, folder: str, pattern: str, state: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Follow new files of a folder; each micro-batch appends what it saw (path, source_digest, length, modified) to the state,
    as a part of its own. Without seconds, all that is there is read and the query ends."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    found = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_digest"), "length", F.col("modificationTime").alias("modified"))

    def append(batch: DataFrame, epoch: int) -> None:
        """Idempotent by epoch: a retried batch writes the same part again."""
        _seen(batch).write.mode("overwrite").parquet(f"{state}/part=epoch-{epoch:09d}")

    out = found.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def _seen(rows: DataFrame, *more: str) -> DataFrame:
    """rows as a part of the state: with the time at which they were seen, by which a later part wins over an earlier one."""
    return rows.select("path", "source_digest", "length", "modified", F.current_timestamp().alias("seen"), *more)


def rescan(spark: SparkSession, folder: str, pattern: str, state: str) -> DataFrame:
    """path, action of the files that are new, edited or gone since the state was last written, which become a part of it: a
    stream sees a path once, so edits are found by another look at the folder. A file of the same length and time isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    old = latest(spark, state).select("path", F.col("source_digest").alias("_digest"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    stat = files.select("path", "length", F.col("modificationTime").alias("modified"))
    both = stat.join(old, "path", "full_outer")
    same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
    changed = both.filter(~F.coalesce(same, F.lit(False)))
    read = files.join(changed.filter("length is not null").select("path"), "path", "left_semi").select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_digest"))
    rows = changed.join(read, "path", "left")
    action = F.when(F.col("length").isNull(), "removed").when(F.col("_digest").isNull(), "new").when(F.col("source_digest") != F.col("_digest"), "edited")
    at = f"{state}/part=scan-{uuid.uuid4().hex}"
    _seen(rows.withColumn("action", action), "action").write.parquet(at)
    return spark.read.parquet(at).filter("action is not null").select("path", "action")


STATE = "path string, source_digest string, length long, modified timestamp, seen timestamp"


def latest(spark: SparkSession, state: str) -> DataFrame:
    """path, source_digest, length, modified of the files that are there, by what was last seen of each."""
    rows = spark.read.schema(STATE).parquet(f"{state}/part=*")
    last = F.max(F.struct("seen", "modified", "source_digest", "length")).alias("last")  # partial before it moves
    return rows.groupBy("path").agg(last).filter("last.length is not null").select("path", "last.source_digest", "last.length", "last.modified")
