"""Versions under several writers, their digest trees, and the collector."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomdex.sources import snapshots
from loomdex.sources.snapshots import Conflict, Snapshots


def rows(spark, n, mark=0):
    return spark.range(n).select("id", (F.col("id") * 3 + mark).alias("v"))


def chain(s):
    out, at = [], s.current()
    while at:
        out.append(at)
        at = s.manifest(at)["parent"]
    return out


def test_two_writers_at_once(spark, tmp_path):
    """Both publish on top of the first: three versions, three lines, one chain."""
    first = Snapshots(spark, str(tmp_path / "s")).publish({"t": rows(spark, 3)})
    ready, got, wrong = threading.Barrier(2), {}, []

    def write(mark):
        try:
            s = Snapshots(spark, str(tmp_path / "s"))
            commit, waited = s._commit, []

            def late(make):
                def entry(state):
                    if not waited:  # both have read the log before either writes to it
                        waited.append(1)
                        ready.wait(60)
                    return make(state)

                return commit(entry)

            s._commit = late
            got[mark] = s.publish({"t": rows(spark, 3, mark)})
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong
    s = Snapshots(spark, str(tmp_path / "s"))
    assert [j["n"] for j in s.journal()] == [1, 2, 3] and len(s.listed()) == 3
    assert chain(s)[-1] == first and set(chain(s)) == {first, *got.values()} and len(chain(s)) == 3
    assert {m: s.read("t", at).filter("id = 0").first().v for m, at in got.items()} == {1: 1, 2: 2}
    assert not os.listdir(tmp_path / "s" / "intents") and not os.listdir(tmp_path / "s" / "drafts")


def test_a_base_that_has_moved(spark, tmp_path):
    s, t = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    one = s.publish({"a": rows(spark, 2), "b": rows(spark, 5)}, base=None)
    two = t.publish({"a": rows(spark, 3)}, keep=["b"], base=one)
    assert t.manifest(two)["tables"]["b"] == t.manifest(one)["tables"]["b"] and t.read("b").count() == 5
    with pytest.raises(Conflict):
        s.publish({"a": rows(spark, 9)}, base=one)
    with pytest.raises(ValueError):
        s.publish({}, keep=["a"])
    assert s.current() == two and len(os.listdir(tmp_path / "s" / "data")) == 2


def test_collector_spares_what_is_written(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    one = s.publish({"a": rows(spark, 2), "b": rows(spark, 5)})
    two = s.publish({"a": rows(spark, 3)}, keep=["b"], base=one)
    at = tmp_path / "s"
    for name in ("writing", "crashed", "stray"):
        (at / "data" / name).mkdir()
    (at / "intents" / "writing").write_text("{}")
    (at / "intents" / "crashed").write_text("{}")
    os.utime(at / "intents" / "crashed", (time.time() - 2 * snapshots.ABANDONED,) * 2)
    assert s.collect(1) == [one] and s.listed() == [two]
    kept = set(os.listdir(at / "data"))
    assert "writing" in kept and not kept & {"crashed", "stray"}
    assert s.read("b").count() == 5  # what the version that went shared is still there
    with pytest.raises(ValueError):
        s.rollback(one)
    assert [j["action"] for j in s.journal()] == ["publish", "publish", "collect"]


def test_damage_is_seen(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    one = s.publish({"t": rows(spark, 4)})
    s.publish({"t": rows(spark, 5)})
    assert s.verify(one) == []
    # two rows exchange a digit: sums of the columns stay
    spark.createDataFrame([(0, 3), (1, 0), (2, 6), (3, 9)], "id long, v long").write.mode("overwrite").parquet(str(tmp_path / "s" / s.manifest(one)["tables"]["t"]["path"]))
    with pytest.raises(ValueError, match="t of"):
        s.rollback(one)


def test_trees_find_the_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LEAF", 4)
    s = Snapshots(spark, str(tmp_path / "s"))
    keys = {"t": ["id"]}
    one = s.publish({"t": rows(spark, 900)}, keys=keys)
    now = rows(spark, 901).filter("id <> 7").withColumn("v", F.when(F.col("id") == 500, -1).otherwise(F.col("v")))
    two = s.publish({"t": now}, keys=keys)
    t = s.manifest(two)["tables"]["t"]
    assert t["depth"] == 2 and t["rows"] == 900
    assert s.changed_ranges("t", one, two).count() <= 3
    assert {tuple(r) for r in s.changes("t", one, two).collect()} == {(7, "removed"), (500, "changed"), (900, "added")}
    three = s.publish({"t": now.repartition(5).orderBy(F.desc("v"))}, keys=keys)
    assert s.manifest(three)["tables"]["t"]["digest"] == t["digest"] and s.changes("t", two, three).count() == 0
    four = s.publish({"t": now.filter("id < 40")}, keys=keys)  # a tree of another depth
    assert s.changes("t", three, four).groupBy("change").count().collect() == [("removed", 861)]


def test_repeated_null_and_no_rows(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    none = s.publish({"t": rows(spark, 0)})
    some = s.publish({"t": rows(spark, 2).union(rows(spark, 1)).union(spark.sql("SELECT CAST(NULL AS LONG), 1L"))}, keys={"t": ["id"]})
    more = s.publish({"t": rows(spark, 2).union(rows(spark, 1)).union(rows(spark, 1))}, keys={"t": ["id"]})
    assert s.manifest(none)["tables"]["t"]["digest"] == "" and s.verify(none) == [] == s.verify(some)
    assert {tuple(r) for r in s.changes("t", some, more).collect()} == {(None, "removed"), (0, "changed")}
    assert s.changes("t", none, some).count() == 3


def test_leaves_move_digests_as_bytes_and_say_the_same(spark):
    import hashlib

    some = rows(spark, 50).union(rows(spark, 5))
    each = some.select(snapshots.range_of(["id"], 1).alias("r"), snapshots.row_digest(["id", "v"]).alias("d")).collect()
    by = {}
    for e in each:
        of = by.setdefault(e.r, {}).setdefault(e.d[:2], {})
        of[e.d] = of.get(e.d, 0) + 1
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r: hexed(",".join(f"{p}:" + hexed(",".join(f"{d}:{n}" for d, n in sorted(of.items()))) for p, of in sorted(ps.items()))) for r, ps in by.items()}
    found = snapshots.leaves(some, ["id"], 1)
    assert {x.range: x.digest for x in found.collect()} == want
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
