"""The lexical leg against SQLite's FTS5, which defines the score; fusion, planning, packing and walks."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import graph, lexical, retrieval
from loomdex.plans import planner
from loomdex.plans.search import Settings, search

ROWS = [
    ("a", "Retry policies retry the request with backoff", "Retries", "Policy", "Guide"), ("b", "Queue depth and queue retries", "Queues", "Depth", "Guide"),
    ("c", "foo_bar is a helper; foo bar is not", "Helpers", "foo_bar", "API / Names"), ("d", "Café naïve résumé", "Accents", "Letters", "Text"), ("e", "nothing to see here", "Empty", "", ""),
    ("f", "the request the request the request", "Requests", "Request", "Guide"), ("g", "policy policies policed", "Policy", "Retry", "Guide"),
]
FIELDS = list(lexical.WEIGHTS)


def fts5(query, k=50):
    """The score by SQLite itself, with the arms built as the engine builds them."""
    con = sqlite3.connect(":memory:")
    cols = FIELDS + [f"s_{f}" for f in FIELDS]
    con.execute(f"create virtual table t using fts5(anchor unindexed, {', '.join(cols)}, tokenize='unicode61')")
    stem = lambda s: " ".join(X.porter(w) for w in __import__("re").findall(r"\w+", s.lower()))
    for r in ROWS:
        con.execute(f"insert into t values ({', '.join('?' * 9)})", [*r, *map(stem, r[1:])])
    terms = [t for t in __import__("re").findall(r"\w+", query.lower()) if t not in X.STOPWORDS][:64]
    arms = [f"{{{' '.join(FIELDS)}}} : \"{t}\"" for t in terms] + [f"{{{' '.join('s_' + f for f in FIELDS)}}} : \"{s}\"" for s in dict.fromkeys(map(X.porter, terms))]
    weights = [lexical.WEIGHTS[f] for f in FIELDS] + [lexical.STEM * lexical.WEIGHTS[f] for f in FIELDS]
    got = con.execute(f"select anchor, -bm25(t, 0, {', '.join(map(str, weights))}) s from t where t match ? order by s desc, anchor limit {k}", [" OR ".join(arms)])
    return {a: round(s, 6) for a, s in got}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "anchor string, text string, title string, heading string, ancestors string")


@pytest.mark.parametrize("query", ["retry", "retry retry queue", "foo_bar", "cafe resume", "policies request", "nothing here request"])
def test_bm25_is_fts5(spark, rows, query):
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    got = {r.anchor: r.score for r in lexical.bm25(q, rows, lexical.WEIGHTS, 50, stemmed=True, foothold=False).collect()}
    expect = fts5(query)
    assert got.keys() == expect.keys() and all(abs(got[a] - expect[a]) < 2e-6 for a in got)


def test_filters_leave_statistics_alone(spark, rows):
    q = spark.createDataFrame([(1, "retry request")], "query_id int, query string")
    full = {r.anchor: r.score for r in lexical.bm25(q, rows, lexical.WEIGHTS, 50, True).collect()}
    some = {r.anchor: r.score for r in lexical.bm25(q, rows, lexical.WEIGHTS, 50, True, keep=F.col("anchor").isin("a", "f")).collect()}
    assert some and all(full[a] == s for a, s in some.items()) and set(some) <= {"a", "f"}


def test_foothold(spark, rows):
    q = spark.createDataFrame([(1, "retrying"), (2, "retry")], "query_id int, query string")
    assert {r.query_id for r in lexical.bm25(q, rows, lexical.WEIGHTS, 50, True).collect()} == {2}
    assert {r.query_id: r.answerable for r in lexical.footholds(q, rows).collect()} == {1: False, 2: True}


def test_rrf(spark):
    legs = spark.createDataFrame([(1, "lexical", "a", 1), (1, "lexical", "b", 2), (1, "vector", "b", 1), (1, "vector", "c", 2)], "query_id int, leg string, anchor string, rank int")
    got = [(r.anchor, r.rank, r.n_legs) for r in retrieval.rrf(legs, 10).orderBy("rank").collect()]
    assert got == [("b", 1, 2), ("a", 2, 1), ("c", 3, 1)]
    assert [r.anchor for r in retrieval.rrf(legs, 1, {"vector": 0.1}).collect()] == ["b"]


def test_pack_skips_and_reports(spark):
    hits = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 80), (1, 3, "c", 40), (2, 1, "d", 500), (2, 2, "e", 1)], "query_id int, rank int, anchor string, tokens int")
    got = {r.query_id: (r.kept, r.omitted, r.spent, r.exceeded) for r in retrieval.pack(hits, 100).collect()}
    assert got == {1: (["a", "c"], ["b"], 90, False), 2: ([], ["d", "e"], 0, True)}


def test_decay_is_the_greedy_choice(spark):
    hits = [(1, f"x{k}", "p" if k < 5 else f"d{k}", 10.0 - k, k + 1) for k in range(9)]
    df = spark.createDataFrame(hits, "query_id int, anchor string, doc string, score double, rank int")
    taken, left, greedy = {}, list(hits), []
    while left:
        best = max(left, key=lambda h: (h[3] * 0.7 ** taken.get(h[2], 0), -h[4]))
        greedy.append(best[1])
        taken[best[2]] = taken.get(best[2], 0) + 1
        left.remove(best)
    assert [r.anchor for r in retrieval.document_decay(df, 0.7).orderBy("rank").collect()] == greedy
    assert [r.anchor for r in retrieval.document_cap(df, 2).orderBy("rank").collect()] == ["x0", "x1", "x5", "x6", "x7", "x8"]


@pytest.mark.parametrize("query,rules,generators", [
    ("what depends on the queue", "relationship", "graph,lexical,vector"), ("how do retries work", "natural-language", "lexical,vector"), ("RetryPolicy defaults", "identifier", "lexical,symbol,vector"),
    ("uv lock --check", "command", "lexical,symbol,vector"), ("how do i install a tool", "natural-language", "lexical,vector"), ("v0.4.0", "natural-language", "lexical,vector"), ('"exact phrase"', "identifier", "lexical,symbol,vector"),
])
def test_planner(spark, query, rules, generators):
    r = planner.plan(spark.createDataFrame([(query,)], "query string")).first()
    assert (",".join(r.rules), ",".join(r.generators)) == (rules, generators)


def test_search_serves_by_status(spark):
    docs = spark.createDataFrame([(1, "p/1.md", "T", "n", "c", "authored", "verified"), (2, "p/2.md", "T", "n", "c", "authored", "candidate")], "doc_id int, path string, title string, namespace string, collection string, trust string, status string")
    chunks = spark.createDataFrame([("p/1.md#/0", 1, "retry the queue", 3), ("p/2.md#/0", 2, "retry the queue now", 4)], "anchor string, doc_id int, text string, tokens int")
    q = spark.createDataFrame([(1, "retry queue")], "query_id int, query string")
    assert [r.anchor for r in search(q, docs, chunks).collect()] == ["p/1.md#/0"]
    assert search(q, docs, chunks, Settings(include_candidate=True)).count() == 2
    assert search(q, docs, chunks, Settings(status=["candidate"])).count() == 0
    with pytest.raises(ValueError):
        retrieval.search_filter(status=[])


def test_resolution_cascade(spark):
    docs = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("c/y.md",), ("a/sub/z.md",)], "path string")
    aliases = spark.createDataFrame([("zed", "a/sub/z.md"), ("two", "a/x.md"), ("two", "b/y.md"), ("y", "a/x.md")], "alias string, path string")
    links = [("a/x.md", k, t) for k, t in enumerate(["#part", "b/y.md", "sub/z.md", "../b/y.md", "z", "y", "ZED", "two", "none", "https://e.org/x"])]
    got = {r.target: (r.to_path, r.reason) for r in graph.resolve(spark.createDataFrame(links, "path string, ord int, target string"), docs, aliases).collect()}
    assert got == {
        "#part": ("a/x.md", "resolved"), "b/y.md": ("b/y.md", "resolved"), "sub/z.md": ("a/sub/z.md", "resolved"), "../b/y.md": ("b/y.md", "resolved"), "z": ("a/sub/z.md", "resolved"),
        "y": (None, "ambiguous name"), "ZED": ("a/sub/z.md", "resolved"), "two": (None, "ambiguous alias"), "none": (None, "no such document"), "https://e.org/x": (None, "external"),
    }


def test_walks(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "links_to"), ("e2", "b", "c", "links_to"), ("e3", "c", "d", "cites"), ("e4", "a", "b", "cites")], "edge_id string, source string, target string, type string")
    origin = spark.createDataFrame([("a",)], "origin string")
    assert {(r.node, r.depth) for r in graph.neighbours(origin, edges, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in graph.neighbours(origin, edges, 3, ["cites"]).collect()} == {"b"}
    with pytest.raises(ValueError):
        graph.neighbours(origin, edges, 4)
    seeds = spark.createDataFrame([(1, 1, "a"), (1, 2, "c")], "query_id int, seed_rank int, node string")
    assert {(r.node, r.seed_rank, r.round) for r in graph.round_robin(seeds, edges).collect()} == {("b", 1, 1), ("d", 2, 1)}
