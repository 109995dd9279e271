"""Names of any number of lengths are searched."""

from loomdex.operators import graph


def test_names_of_twenty_lengths(spark):
    words = [f"word{k}" for k in range(20)]
    names = spark.createDataFrame([(f"n{k}", " ".join(words[:k])) for k in range(1, 21)], "slug string, name string")
    rows = spark.createDataFrame([("d", "d/1", 1, " ".join(words))], "doc_id string, anchor string, ordinal int, text string")
    assert {r.slug for r in graph.entity_mentions(names, rows).collect()} == {f"n{k}" for k in range(1, 21)}
