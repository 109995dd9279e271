"""Rows that repeat the query's id take no place from others with the same vector."""

from loomdex.llm import ann


def test_repeated_query_id(spark):
    rows = [(0, [1.0, 0.0])] * 4 + [(k, [1.0, 0.0]) for k in (1, 2, 3)] + [(k, [0.5, 0.5]) for k in (4, 5, 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, k=3).filter("query_id = 0 and rank <= 3").collect()
    assert got and {r.vec_id for r in got} == {1, 2, 3}
