"""A measured search: what each leg gave, and a vector leg that fails without failing the search."""

from pyspark.sql import functions as F

from loomdex.plans.report import measured
from loomdex.plans.search import Settings, search


def tables(spark):
    docs = spark.createDataFrame([(1, "a.md", "A", "n", "c", "authored", "current"), (2, "b.md", "B", "n", "c", "authored", "current")], "doc_id long, path string, title string, namespace string, collection string, trust string, status string")
    chunks = spark.createDataFrame([("a.md#a/0", 1, "retry the request", 3), ("b.md#b/0", 2, "queue depth", 2)], "anchor string, doc_id long, text string, tokens int")
    return spark.createDataFrame([(1, "retry"), (2, "queue"), (3, "absent")], "query_id long, query string"), docs, chunks


def test_legs_are_counted(spark):
    queries, docs, chunks = tables(spark)
    settings = Settings(hybrid=True, weights={"text": 1.0}, include_candidate=True, graph=True)
    near = lambda q: q.filter("query_id = 1").select("query_id", F.explode(F.array(F.struct(F.lit("a.md#a/0").alias("anchor"), F.lit(1).alias("rank")), F.struct(F.lit("b.md#b/0").alias("anchor"), F.lit(2).alias("rank")))).alias("h")).select("query_id", "h.*")
    hits, report = measured(queries, docs, chunks, settings, near)
    by = {r.leg: r for r in report.collect()}
    assert {k: (r.state, r["rows"]) for k, r in by.items()} == {"lexical": ("ok", 2), "vector": ("ok", 2), "symbol": ("off", 0), "graph": ("off", 0), "hits": ("ok", 3)}
    assert by["vector"].seconds > 0 and by["hits"].seconds > 0 and by["graph"].note == "there is no table of edges"
    plain = search(queries, docs, chunks, settings, near(queries))
    assert sorted(map(str, hits.collect())) == sorted(map(str, plain.collect()))


def test_a_failing_vector_leg_is_told_and_left_out(spark):
    queries, docs, chunks = tables(spark)
    settings = Settings(hybrid=True, weights={"text": 1.0}, include_candidate=True)

    def on_the_driver(asked):
        raise ConnectionError("no route\nto host")

    in_a_task = lambda q: q.select("query_id", F.col("query").alias("anchor"), F.raise_error(F.lit("boom")).cast("int").alias("rank"))
    for leg, says in ((on_the_driver, "ConnectionError: no route"), (in_a_task, "boom")):
        hits, report = measured(queries, docs, chunks, settings, leg)
        row = report.filter("leg = 'vector'").first()
        assert row.state == "failed" and says in row.note and row["rows"] == 0
        assert {(r.query_id, r.anchor) for r in hits.collect()} == {(1, "a.md#a/0"), (2, "b.md#b/0")}
    _, report = measured(queries.limit(0), docs, chunks, Settings(weights={"text": 1.0}))
    assert {r["rows"] for r in report.collect()} == {0}
