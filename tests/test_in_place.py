"""Texts stay where they are read: neither a search nor the re-rankers of documents move them to meet other tables."""

from pyspark.sql import functions as F

from loomdex import queries
from loomdex.functions.work import written
from loomdex.operators import graph, lexical
from loomdex.plans import search as plans

from .test_report import tables
from .test_scan import plan_of


def test_search_reads_texts_without_a_join(spark, monkeypatch):
    asked, docs, chunks = tables(spark)
    seen, index = [], lexical.index

    def watched(rows, *more, **named):
        seen.append(plan_of(rows))
        return index(rows, *more, **named)

    monkeypatch.setattr(lexical, "index", watched)
    settings = plans.Settings(weights={"text": 1.0}, include_candidate=True)
    plain = sorted(map(tuple, plans.search(asked, docs, chunks, settings).select("query_id", "anchor", "score", "path").collect()))
    assert len(plain) == 2 and "Join" not in seen[0]
    stray = chunks.unionByName(spark.createDataFrame([("z.md#z/0", 9, "retry queue depth again", 4)], chunks.schema))  # of no document
    assert sorted(map(tuple, plans.search(asked, docs, stray, settings).select("query_id", "anchor", "score", "path").collect())) == plain


def test_document_rerankers_move_only_the_best_rows(spark):
    for name in ("rerank_document_cap", "rerank_document_decay"):
        plan = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and plan.count("Exchange") == plan.count("MapInArrow") == 1


def broadcast_rows(spark):
    """How many rows each broadcast since the session began had."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for e in (runs.apply(k).executionId() for k in range(runs.size())):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                ms = node.metrics()
                for m in (ms.apply(k) for k in range(ms.size())):
                    if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                        out[e, m.accumulatorId()] = int(v.get().replace(",", ""))
    return out


def test_no_table_of_the_corpus_goes_through_the_driver(spark, tmp_path):
    """However small its compressed file is."""
    n = 3000
    each = spark.range(n).withColumn("path", F.concat(F.col("id").cast("string"), F.lit(".md")))
    docs = each.select(F.col("id").alias("doc_id"), "path", *[F.lit("x").alias(c) for c in ("title", "namespace", "collection", "trust", "status")])
    chunks = each.select(F.concat("path", F.lit("#/0")).alias("anchor"), F.col("id").alias("doc_id"), F.lit("retry queue").alias("text"), F.lit(2).alias("tokens"))
    symbols = each.select(F.concat(F.lit("sym:python:pkg.item_"), "id").alias("symbol"), F.array(F.concat("path", F.lit("#/0"))).alias("doc_refs"))
    edges = graph.edges(each.select("path", F.concat((F.col("id") + 1).cast("string"), F.lit(".md")).alias("to_path"), F.lit(0).cast("long").alias("ord")))
    docs, chunks, symbols, edges = (written(t, "corpus-table") for t in (docs, chunks, symbols, edges))
    asked = spark.createDataFrame([(1, "retry related to pkg.item_2999")], "query_id long, query string")
    settings = plans.Settings(limit=60, symbols=True, graph=True, stems=False, include_candidate=True, weights={"text": 1.0})
    before = set(broadcast_rows(spark))
    hits = plans.search(asked, docs, chunks, settings, symbols=symbols, edges=edges).collect()
    legs = {leg for r in hits for leg in r.legs}
    assert legs == {"lexical", "symbol", "graph"} and len(hits) > 50
    assert all(rows < n for at, rows in broadcast_rows(spark).items() if at not in before)
