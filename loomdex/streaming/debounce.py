"""Debouncing as keyed state: batches of a stream's events, closed by silence or cut by a ceiling, in event time.

A key's state is its open batch, the events that the watermark hasn't passed yet, and the last digest of each of its
paths. Nothing else is kept, and a batch leaves as a row when a timer says that it is over, so the sink only appends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The only state store that keeps several variables of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
#: Seconds of silence that close a batch, and after which one is cut in any case.
QUIET, CEILING = 0.3, 5.0

FIELDS = ["session", "part", "begun", "started", "ended", "events"]


class Debounce(StatefulProcessor):
    """rows: event_us (microseconds), event_path, event_digest, event_tick. An event whose digest is the last one seen of its path says that nothing has
    changed, and drops out; one without a digest never does. A tick only moves time."""

    def __init__(self, quiet: float, ceiling: float | None) -> None:
        self.quiet, self.ceiling = int(quiet * 1e6), int(ceiling * 1e6) if ceiling is not None else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{f} long" for f in FIELDS) + ", closed long")
        self.pending = handle.getListState("pending", "us long, path string, digest string")
        self.seen = handle.getMapState("seen", "path string", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            real = part[~part["event_tick"].astype(bool)] if len(part) else part  # a call for a timer alone has a frame without columns
            if len(real):
                self.pending.appendList([(int(u), p, d) for u, p, d in zip(real["event_us"], real["event_path"].fillna(""), real["event_digest"].fillna(""), strict=True)])
        yield from self.advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues)

    def advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Take in what the watermark has passed, in order of time, and close what it leaves behind."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.pending.get()) if self.pending.exists() else []
        due, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        held = dict(zip([*FIELDS, "closed"], self.open.get(), strict=True)) if self.open.exists() else dict.fromkeys([*FIELDS, "closed"], 0)
        done: list[dict] = []

        def leave() -> None:
            if held["events"]:
                done.append({f: held[f] for f in FIELDS if f != "begun"})
                held["events"] = 0

        for us, path, digest in due:
            if digest:
                if self.seen.containsKey((path,)) and self.seen.getValue((path,))[0] == digest:
                    continue
                self.seen.updateValue((path,), (digest,))
            if held["closed"] == held["session"] or us - held["ended"] > self.quiet:
                leave()
                held |= {"session": held["session"] + 1, "part": 0, "begun": us}
            part = (us - held["begun"]) // self.ceiling if self.ceiling else 0
            if part != held["part"]:
                leave()
            held |= {"part": part, "started": held["started"] if held["events"] else us, "ended": us, "events": held["events"] + 1}
        if held["session"] and held["closed"] < held["session"] and now - held["ended"] > self.quiet:
            leave()
            held["closed"] = held["session"]
        self.pending.put(later) if later else self.pending.clear()
        self.open.update(tuple(int(held[f]) for f in [*FIELDS, "closed"]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        at = later[0][0] if later else held["ended"] + self.quiet if held["closed"] < held["session"] else None
        if at is not None:
            self.handle.registerTimer(max(at, now) // 1000 + 1)
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), **{f: [d[f] for d in done] for f in done[0]}})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, ts: str, quiet: float = QUIET, ceiling: float | None = CEILING, late: str = "10 seconds", path: str | None = None, digest: str | None = None, tick: str | None = None) -> DataFrame:
    """key, session, part, started, ended, events of a stream, as watching.sessions() has them of a table: a row for each batch once
    ``late`` has passed over its end. path, digest: of what the event is about; tick: a boolean column of rows that are no
    events but move the watermark. The session's state store has to be STORE when the stream starts."""
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    stamp = F.col(ts).cast("timestamp")
    named = F.to_json(F.struct(F.col(key).alias("k")))  # so that a null key is one like any other
    rows = events.select(named.alias("key"), stamp.alias("_ts"), F.unix_micros(stamp).alias("event_us"), text(path).alias("event_path"), text(digest).alias("event_digest"), (F.coalesce(F.col(tick), F.lit(False)) if tick else F.lit(False)).alias("event_tick"))
    kind = events.schema[key].dataType.simpleString()
    schema = "key string, session long, part long, started long, ended long, events long"
    out = rows.withWatermark("_ts", late).groupBy("key").transformWithStateInPandas(Debounce(quiet, ceiling), schema, "Append", "EventTime")
    return out.select(F.from_json("key", f"k {kind}")["k"].alias(key), "session", "part", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "events")
