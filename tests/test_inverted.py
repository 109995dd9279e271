"""The stored index scores as one made anew, and reads the buckets of the asked terms only."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.corpus import Corpus
from loomdex.operators import inverted, lexical
from loomdex.operators.inverted import Index
from tests.test_corpus import FILES

SCHEMA = "anchor string, text string, title string"
WEIGHTS = {"text": 1.0, "title": 3.0}
ROWS = {
    "a": ("Retries of a queue, retried again and again", "Queues"), "b": ("A retry_policy waits; well-known policy", "Retry"), "c": (None, "well known"),
    "d": ("known well, well known", ""), "e": ("nothing of that", "Other"), "f": ("queue queue queue waits for retries", None), "g": ("", ""),
}
ASKED = [("1", 'retries "well known"'), ("2", "queue waiting"), ("3", "retry_policy known known"), ("4", "absent"), ("5", "well-known")]


def table(spark, keys, **other):
    return spark.createDataFrame([(k, *(other.get(k) or ROWS[k])) for k in keys], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "anchor", "score", "rank").collect())


@pytest.mark.parametrize("stemmed", [True, False])
def test_equal_to_an_index_made_anew(spark, tmp_path, stemmed):
    asked = spark.createDataFrame(ASKED, "query_id string, query string")
    found = Index(spark, str(tmp_path / "i"), ["text", "title"], stemmed, buckets=8)
    found.update(table(spark, "abcx", b=("other words", "Other"), x=("queue waits", "queue")))
    found.update(table(spark, "bde"), spark.createDataFrame([("x",), ("never",)], "key string"))
    found.update(table(spark, "fg"))
    for mode in ("any", "all"):
        want = rows(lexical.bm25(asked, table(spark, "abcdefg"), WEIGHTS, 5, stemmed, mode=mode))
        assert rows(found.bm25(asked, WEIGHTS, 5, mode=mode)) == want and want
    keep = spark.createDataFrame([("d",), ("f",)], "key string")
    assert rows(found.bm25(asked, WEIGHTS, 5, keep)) == rows(lexical.bm25(asked, table(spark, "abcdefg"), WEIGHTS, 5, stemmed, keep=F.col("anchor").isin("d", "f")))
    before = rows(found.bm25(asked, WEIGHTS, 5))
    found.compact()
    assert len(found._tables("postings")) == 1 and not found._tables("void") and rows(found.bm25(asked, WEIGHTS, 5)) == before
    with pytest.raises(ValueError):
        found.bm25(asked, {"text": 1.0}, 5)


def test_reads_the_asked_buckets_only(spark, tmp_path, capsys):
    found = Index(spark, str(tmp_path / "i"), ["text", "title"], False, buckets=64)
    found.update(table(spark, "abcdef"))
    arms = lexical.arms(spark.createDataFrame([("1", "queue")], "query_id string, query string"))
    found.matches(arms).explain("formatted")
    bucket = spark.range(1).select(found._bucket(F.lit("queue"))).first()[0]
    plan = capsys.readouterr().out
    assert f"(bucket#" in plan and f"= {bucket})" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_the_corpus_keeps_its_index(spark, tmp_path):
    """After an edit only the chunks that differ come into a new segment, and a search says the same with the index and without."""
    c = Corpus(spark, str(tmp_path / "s"))
    c.build(spark.createDataFrame(sorted(FILES.items()), "path string, text string"))
    c.reindex()
    assert c._index() is not None
    files = {**FILES, "notes/plain.md": "# Plain\n\nRequests that wait for a queue.\n"}
    del files["evidence/source.md"]
    c.build(spark.createDataFrame(sorted(files.items()), "path string, text string"))
    assert c._index() is None
    asked = spark.createDataFrame([("a", "retries of a queue"), ("b", "requests waiting")], "query_id string, query string")
    want = sorted(map(str, c.search(asked).collect()))
    c.reindex()
    assert c._index() is not None and sorted(map(str, c.search(asked).collect())) == want
    new = c.index.versions.read(c.index._tables("rows")[2]).collect()
    assert {r.key.split("#")[0] for r in new} == {"notes/plain.md"}


def test_postings_are_gathered_where_rows_are_read(spark, tmp_path):
    """Of an update only the finished postings move, once: to their buckets."""
    found = Index(spark, str(tmp_path / "i"), ["text", "title"], True)
    index = lexical.index(table(spark, "abcdefg"), found.fields, True)
    plan = found._postings(index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("RebalancePartitions") == 1
    got = {(r.key, r.field, r.term): r.at for r in found._postings(index).collect()}
    assert got["f", "text", "queue"] == [0, 1, 2] and got["a", "+text", "retri"] == [0, 4] and ("g", "text", "") not in got


def test_only_blocks_move(spark, tmp_path):
    """A posting is stored with its place in a part, not with its key, and a search shuffles blocks and live rows."""
    found = Index(spark, str(tmp_path / "i"), ["text", "title"], True, buckets=4)
    found.update(table(spark, "abcdefg"))
    found.update(table(spark, "ab"))
    stored = found.versions.read(found._tables("postings")[1])
    assert sorted(stored.columns) == ["block", "bucket", "part"] and stored.count() <= 4 * stored.select("part").distinct().count()
    plan = found.matches(lexical.arms(spark.createDataFrame(ASKED, "query_id string, query string"), True))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan


def test_many_parts_and_groups(spark, tmp_path, monkeypatch):
    """Parts of a row each, void rows and repeated compactions: scores as of an index made anew."""
    monkeypatch.setattr("loomdex.operators.inverted.PART", 1)
    monkeypatch.setattr("loomdex.operators.inverted.TOKENS", 8)
    asked = spark.createDataFrame(ASKED, "query_id string, query string")
    found = Index(spark, str(tmp_path / "i"), ["text", "title"], True, buckets=3)
    found.update(table(spark, "abcdefg", a=("other words", "Other")))
    found.update(table(spark, "a"))
    found.update(void=spark.createDataFrame([("b",)], "key string"))
    found.update(table(spark, "b"))
    want = rows(lexical.bm25(asked, table(spark, "abcdefg"), WEIGHTS, 5, True))
    for _ in range(2):
        assert rows(found.bm25(asked, WEIGHTS, 5)) == want and want
        found.compact()
    assert rows(found.bm25(asked, WEIGHTS, 5)) == want
    empty = Index(spark, str(tmp_path / "e"), ["text", "title"], True)
    empty.update(table(spark, "a").filter("false"))
    assert empty.bm25(asked, WEIGHTS, 5).count() == 0


def test_blocks_keep_what_went_in():
    names, dl = pa.array(["é", "", "z" * 300, "a\nb"]), np.array([0, 1, 70000, 2**31])
    got, (back, none) = inverted.unpacked(inverted.packed(names, dl, np.zeros(0, np.int64)))
    assert got.equals(names) and back.tolist() == dl.tolist() and not len(none)
    rng = np.random.default_rng(5)
    field, row, code = rng.integers(0, 2, 5000), np.sort(rng.integers(0, 90, 5000)), rng.integers(0, 40, 5000)
    order = np.lexsort((row, field))
    field, row, code, place = field[order], row[order], code[order], np.arange(5000)
    words = pa.array([f"w{k}" for k in range(40)])
    seen = {}
    for _, bucket, block in inverted._blocks(7, field, row, place, code, words, 8):
        some, f, n, r, places, p = inverted._postings_of(block)
        at = 0
        for post, (t, k) in enumerate(zip(np.repeat(np.arange(len(some)), n), places)):
            seen[int(f[t]), some[int(t)].as_py(), int(r[post])] = p[at : at + k].tolist()
            at += k
    want = {}
    for f, r, c, p in zip(field.tolist(), row.tolist(), code.tolist(), place.tolist()):
        want.setdefault((f, f"w{c}", r), []).append(p)
    assert seen == want
