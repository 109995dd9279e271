"""Keyed debounce over streams of several files, held against the batch version."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdex.streaming import debounce, watch

SCHEMA = "user string, ts timestamp, path string, digest string, tick boolean"
BEGIN = dt.datetime(2026, 1, 1)


def streamed(spark, tmp_path, files, **how):
    """Runs a stream over files of rows, one a micro-batch and the last of them a tick far on; the rows of its sink."""
    source, old = tmp_path / "in", spark.conf.get(debounce.STORE_CONF)
    for k, rows in enumerate([*files, [(None, BEGIN + dt.timedelta(days=900), None, None, True)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source / f"{k:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{source}/*")
    out = debounce.debounced(stream, "user", "ts", tick="tick", **how)
    try:
        spark.conf.set(debounce.STORE_CONF, debounce.STORE)
        run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    finally:
        spark.conf.set(debounce.STORE_CONF, old)
    run.awaitTermination(300)
    assert run.exception() is None
    return {(r.user, r.session, r.part, r.started, r.ended, r.events) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}


def rows_of(seed, n):
    rng, at, out = random.Random(seed), {}, []
    for _ in range(n):
        user = rng.choice(["a", "b", None])
        at[user] = at.get(user, BEGIN) + dt.timedelta(seconds=rng.choice([0, 0.1, 0.2, 0.29, 1.0, 7.0]))
        out.append((user, at[user], rng.choice(["x.md", "y.md"]), rng.choice("pq"), False))
    return sorted(out, key=lambda r: r[1])


def test_batches_equal_the_tables(spark, tmp_path):
    rows = rows_of(1, 160)
    want = watch.sessions(spark.createDataFrame(rows, SCHEMA), "user", "ts", 0.3, 0.5)
    # events a little out of order, within and between files
    mixed = rows[:]
    for k in range(0, len(mixed) - 1, 3):
        mixed[k], mixed[k + 1] = mixed[k + 1], mixed[k]
    got = streamed(spark, tmp_path, [mixed[:70], mixed[70:90], mixed[90:]], quiet=0.3, ceiling=0.5, late="30 seconds")
    assert got == {(r.user, r.session, r.part, r.started, r.ended, r.events) for r in want.collect()}


@pytest.mark.parametrize("ceiling", [None])
def test_unchanged_files_drop_out(spark, tmp_path, ceiling):
    rows = [(u, t + dt.timedelta(milliseconds=k), p, d, False) for k, (u, t, p, d, _) in enumerate(rows_of(2, 90))]  # no two at once
    events = spark.createDataFrame(rows, SCHEMA)
    last = F.lag("digest").over(Window.partitionBy("user", "path").orderBy("ts"))
    want = watch.sessions(events.withColumn("_l", last).filter("_l is null or _l <> digest"), "user", "ts", 0.3, ceiling)
    got = streamed(spark, tmp_path, [rows[:40], rows[40:]], quiet=0.3, ceiling=ceiling, late="30 seconds", path="path", digest="digest")
    assert got == {(r.user, r.session, r.part, r.started, r.ended, r.events) for r in want.collect()} and len(got) > 5
