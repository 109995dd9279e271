"""Versions of named tables under one root, for any number of writers.

A version's tables are written first, each in a folder of their own; the version exists once its entry is in the log.
Entries are numbered files that can only be put where none is, so of writers that ask for one number one gets it, and
the others read what it did and ask for the next. All state follows from the log: which versions there are, each one's
parent and tables, which is current, and what has been collected. A publication announces itself before it writes, so
the collector, which looks at folders, announcements and log in this order, never takes what is being written.

Each table's digest is the root of a tree over its rows: a leaf holds the rows whose key's digest begins alike, a node
the digests below it. Equal roots mean equal rows; between versions only leaves that differ are looked into.
"""

from __future__ import annotations

import functools
import json
import operator
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X

#: Rows of a leaf on average, at most.
LEAF = 4096
#: Seconds after which a publication that was announced and not finished counts as given up.
ABANDONED = 86_400


class Conflict(RuntimeError):
    """Another writer has moved the current version since it was read."""


# Digest trees


def row_digest(columns: Iterable[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])), 256)


def range_of(key: list[str], depth: int) -> Column:
    """The first hexadecimal digits of the digest of a row's key."""
    return F.substring(row_digest(key), 1, depth)


def depth_for(rows: int) -> int:
    depth = 0
    while rows > LEAF << 4 * depth:
        depth += 1
    return depth


def leaves(rows: DataFrame, key: list[str], depth: int) -> DataFrame:
    """range, rows, digest: rows that repeat count once with their number, and a range's rows meet in 256 parts before they
    meet as one, so that a range which many rows share is no task's alone."""
    digest = F.unhex(row_digest(rows.columns))  # half of its digits' bytes
    each = rows.select(range_of(key, depth).alias("range"), digest.alias("d")).groupBy("range", "d").agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("d", "n"))), lambda x: F.concat(F.lower(F.hex(x["d"])), F.lit(":"), x["n"].cast("string")))
    part = each.groupBy("range", F.lower(F.hex(F.substring("d", 1, 1))).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(lines, ","), 256).alias("d"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat("p", F.lit(":"), "d"))), ",")
    return part.groupBy("range").agg(F.sum("n").alias("rows"), F.sha2(whole, 256).alias("digest"))


def root(found: DataFrame, depth: int) -> DataFrame:
    """rows, digest of the tree over leaves: each level folds sixteen ranges into one. No row where there are no leaves."""
    for d in range(depth - 1, -1, -1):
        below = F.array_join(F.array_sort(F.collect_list(F.concat("range", F.lit(":"), "digest"))), ",")
        found = found.groupBy(F.substring("range", 1, d).alias("range")).agg(F.sum("rows").alias("rows"), F.sha2(below, 256).alias("digest"))
    return found.select("rows", "digest")


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """range of the leaves that are not in both alike."""
    both = old.select("range", F.col("digest").alias("_o")).join(new.select("range", F.col("digest").alias("_n")), "range", "full_outer")
    return both.filter(~F.col("_o").eqNullSafe(F.col("_n"))).select("range")


def row_changes(old: DataFrame, new: DataFrame, key: list[str], ranges: DataFrame, depth: int) -> DataFrame:
    """key columns, change: the keys that were added, removed or changed, among the rows of ranges. Rows that share a key are compared
    together."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        some = rows.withColumn("_range", range_of(key, depth)).join(ranges.withColumnRenamed("range", "_range"), "_range", "left_semi")
        each = some.select(*key, row_digest(rows.columns).alias("_d")).groupBy(*key).agg(F.array_sort(F.collect_list("_d")).alias(name))
        return each.select(*[F.col(f"`{k}`").alias(f"{name}{i}") for i, k in enumerate(key)], name)

    a, b = side(old, "_a"), side(new, "_b")
    alike = functools.reduce(operator.and_, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(key))])
    met = a.join(b, alike, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    names = [F.when(F.col("_b").isNull(), F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")).alias(k) for i, k in enumerate(key)]
    return met.select(*names, change.alias("change")).filter("change is not null")


# The log


@dataclass
class State:
    """What the log's first n entries say."""

    n: int = 0
    current: str | None = None
    versions: dict[str, dict] = field(default_factory=dict)
    gone: set[str] = field(default_factory=set)

    def add(self, entry: dict) -> None:
        self.n = entry["n"]
        if entry["action"] == "publish":
            self.versions[entry["snapshot"]] = entry
            self.gone.discard(entry["snapshot"])
        if entry["action"] in ("publish", "rollback"):
            self.current = entry["snapshot"]
        if entry["action"] == "collect":
            self.gone |= set(entry["gone"])

    def kept(self) -> list[str]:
        return sorted(s for s in self.versions if s not in self.gone)


class Snapshots:
    """The versions under a root; see the module. A reader sees the old version or the new one, never a part."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: list[dict] = []

    # Files

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> dict[str, float]:
        """The names in a folder, and when each was last changed."""
        fs, at = self._at(path)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def _get(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _put_if_absent(self, path: str, text: str) -> bool:
        """Whether this call made the file, whole: of several at once one does. On a local disk by a link, which fails where its
        name is taken; else by a rename that doesn't replace, which HDFS makes one step; stores need conditional writes."""
        draft = f"drafts/{uuid.uuid4().hex}"
        self._put(draft, text)
        fs, at = self._at(path)
        _, draft_at = self._at(draft)
        jvm = self.spark._jvm
        fs.mkdirs(at.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (at, draft_at)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft_at, at, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            return False
        finally:
            self._remove(draft)
        return True

    # The log

    def journal(self) -> list[dict]:
        """What was published, rolled back and collected, in order. Entries never change, so each is read once."""
        names = sorted(n for n in self._names("log") if n.endswith(".json"))
        self._seen += [json.loads(self._get(f"log/{n}")) for n in names[len(self._seen) :]]
        return list(self._seen)

    def state(self) -> State:
        out = State()
        for entry in self.journal():
            out.add(entry)
        return out

    def _commit(self, make: Callable[[State], dict]) -> dict:
        """Append what make says of the state that it follows; make is asked again whenever another writer was first."""
        while True:
            state = self.state()
            entry = {"n": state.n + 1, **make(state)}
            if self._put_if_absent(f"log/{entry['n']:012d}.json", json.dumps(entry, sort_keys=True)):
                return entry

    # Versions

    def current(self) -> str | None:
        return self.state().current

    def listed(self) -> list[str]:
        return self.state().kept()

    def manifest(self, snapshot: str) -> dict:
        """snapshot, parent, config and tables (by name: path, rows, digest, depth and key) of a version; empty if there is none."""
        state = self.state()
        return state.versions[snapshot] if snapshot in state.kept() else {}

    def _write(self, name: str, rows: DataFrame, place: str, key: list[str] | None, by: list[str]) -> dict:
        path = f"data/{place}/{name}"
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{path}")
        got = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}")
        depth, key, at = depth_for(got.count()), key or rows.columns, f"data/{place}/_leaves/{name}"
        if depth:  # a tree of one leaf is its root
            leaves(got, key, depth).write.parquet(f"{self.root}/{at}")
        top = root(self.spark.read.parquet(f"{self.root}/{at}") if depth else leaves(got, key, 0), depth).first()
        return {"path": path, "leaves": at if depth else None, "rows": top.rows if top else 0, "digest": top.digest if top else "", "depth": depth, "key": key}

    def publish(self, tables: dict[str, DataFrame], config: dict | None = None, keys: dict[str, list[str]] | None = None, keep: Iterable[str] = (), base: str | None = "", partitions: dict[str, list[str]] | None = None, note: dict | None = None) -> str:
        """A new version on top of the current one, and its id.

        keep: tables that the version shares with base, by reference. base: the version that the tables were made from (or
        None, where there was none); if another writer has moved on from it, Conflict is raised and nothing is published.
        Without a base the version goes on top of whatever is current then. partitions: the columns by which a table's files lie
        in folders; note: what the log is to say of the version.
        """
        if list(keep) and not base:
            raise ValueError("tables can be kept of a base only")
        place = uuid.uuid4().hex
        self._put(f"intents/{place}", json.dumps({"began": time.time()}))
        done = False
        try:
            held = {n: self._write(n, rows, place, (keys or {}).get(n), (partitions or {}).get(n, [])) for n, rows in sorted(tables.items())}

            def entry(state: State) -> dict:
                if base != "" and state.current != base:
                    raise Conflict(f"{base} was read, {state.current} is current")
                made = held | {n: state.versions[base]["tables"][n] for n in keep}
                manifest = {"parent": state.current, "tables": {n: {k: t[k] for k in ("rows", "digest")} for n, t in sorted(made.items())}, "config": X.digest_of(config or {}), "note": note}
                return {"action": "publish", "snapshot": X.digest_of(manifest)[7:23], "parent": state.current, "config": manifest["config"], "tables": made, "note": note}

            snapshot = self._commit(entry)["snapshot"]
            done = True
            return snapshot
        finally:
            if not done:
                self._remove(f"data/{place}")
            self._remove(f"intents/{place}")

    def read(self, name: str, snapshot: str | None = None, schema: str | None = None) -> DataFrame:
        """schema: the table's, where it may have been written without a row."""
        state = self.state()
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.root}/{state.versions[snapshot or state.current]['tables'][name]['path']}")

    def verify(self, snapshot: str) -> list[str]:
        """The tables of a version whose rows no longer have the digest of the log."""
        out = []
        for name, t in self.manifest(snapshot)["tables"].items():
            top = root(leaves(self.read(name, snapshot), t["key"], t["depth"]), t["depth"]).first()
            if (top.digest if top else "") != t["digest"]:
                out.append(name)
        return out

    def rollback(self, snapshot: str) -> None:
        """Make an older version current, after its rows have been read again and have the digests of the log."""
        if snapshot not in self.listed():
            raise ValueError(f"there is no version {snapshot}")
        if wrong := self.verify(snapshot):
            raise ValueError(f"{', '.join(wrong)} of {snapshot} has changed")

        def entry(state: State) -> dict:
            if snapshot in state.gone:
                raise ValueError(f"{snapshot} has been collected meanwhile")
            return {"action": "rollback", "snapshot": snapshot}

        self._commit(entry)

    def _leaves(self, name: str, snapshot: str, depth: int) -> DataFrame:
        t = self.manifest(snapshot)["tables"][name]
        if t["depth"] == depth and t["leaves"]:
            return self.spark.read.parquet(f"{self.root}/{t['leaves']}")
        return leaves(self.read(name, snapshot), t["key"], depth)  # of one leaf, or the table has since outgrown its tree

    def changed_ranges(self, name: str, old: str, new: str) -> DataFrame:
        """range of each part of a table's keys that differs between two versions."""
        depth = self.manifest(new)["tables"][name]["depth"]
        return differing(self._leaves(name, old, depth), self._leaves(name, new, depth))

    def changes(self, name: str, old: str, new: str) -> DataFrame:
        """key columns, change (added, removed or changed) between two versions; rows in ranges that don't differ aren't compared."""
        t = self.manifest(new)["tables"][name]
        return row_changes(self.read(name, old), self.read(name, new), t["key"], self.changed_ranges(name, old, new), t["depth"])

    def collect(self, keep: int, abandoned: float = ABANDONED) -> list[str]:
        """Give up all but the current version and its newest ``keep - 1`` ancestors, then delete what no version left has and no
        publication is writing; returns the versions that went. They are gone from the log before any file is."""

        def entry(state: State) -> dict:
            live, at = set(), state.current
            while at in state.versions and len(live) < keep:
                live.add(at)
                at = state.versions[at]["parent"]
            return {"action": "collect", "gone": [s for s in state.kept() if s not in live]}

        gone = self._commit(entry)["gone"]
        folders = self._names("data")
        busy = {n for n, at in self._names("intents").items() if time.time() - at < abandoned}
        state = self.state()
        used = {t["path"].split("/")[1] for s in state.kept() for t in state.versions[s]["tables"].values()}
        for place in folders.keys() - used - busy:
            self._remove(f"data/{place}")
        return gone
