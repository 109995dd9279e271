"""Recall of the graph at the registered shard size on several kinds of vectors, block sizes, and exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import ann, topk
from loomdex.llm import vectors as V


def of_kind(kind, n, d):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.3 * x
    if kind in ("unit", "clusters"):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(0, 1, (n, 1))
    return x


@pytest.mark.parametrize(("kind", "d"), [("unit", 64), ("clusters", 64), ("normal", 64), ("normal", 24), ("lengths", 32)])
def test_recall_of_a_registered_shard(kind, d):
    x = of_kind(kind, ann.SHARD, d)
    graph, entry = ann.build(ann.augmented(x))
    ends = np.arange(1, len(x) + 1)
    shard = {"dim": d, "ids": np.arange(len(x)).tobytes(), "nulls": np.zeros(len(x), bool).tobytes(), "data": x.tobytes(), "ends": ends.tobytes(), "graph": graph.astype(np.int32).tobytes(), "entry": entry}
    shard["beam"] = ann.beam_for(x, graph, entry, ann.K, ann.BEAM, 0)
    q_ids = np.arange(0, len(x), 20)
    row, ids, _, _ = ann.search_shard(shard, x[q_ids], q_ids, ann.K, ann.DEGREE)
    scores = x[q_ids] @ x.T
    scores[np.arange(len(q_ids)), q_ids] = -np.inf
    truth = np.argpartition(-scores, ann.K, axis=1)[:, : ann.K]
    hit = sum(len(set(ids[row == i]) & set(truth[i])) for i in range(len(q_ids)))
    assert hit >= 0.9 * truth.size


@pytest.mark.parametrize(("parts", "size"), [(400, 125), (400, 63), (3, 500)])
def test_blocks_are_of_one_size(spark, parts, size):
    df = spark.range(4000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"), F.lit(2).alias("dim")).repartition(parts)
    blocks, n = V.blocked(df, size)
    sizes = [r[0] for r in blocks.select(F.length("nulls")).collect()]
    assert sum(sizes) == 4000 and n == -(-4000 // size) and max(sizes) < size + 8 * size**0.5


def test_large_products_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    data = [(int(i), [float(v) for v in rng.integers(-(2**30), 2**30, 3) * 2.0 ** int(rng.integers(0, 20))]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    whole = [(i, [int(np.floor(64 * v)) for v in x]) for i, x in data]
    expect = []
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-max(min(sum(a * b for a, b in zip(q, c, strict=True)), 2**63 - 1), -(2**63)), j) for j, c in whole if j != i)[:20]
            expect += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(df, block=30, query_block=4).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(expect)


def test_odd_rows(spark):
    """Null ids, other dimensions, components that aren't finite, names that clash."""
    data = [(None, [1.0, 2.0], "a"), (0, [1.0, 0.0], "b"), (20, [1.0, 2.0, 3.0], "c"), (40, [float("nan"), 1.0], "d"), (3, [2.0, 2.0], "e"), (5, [float("-inf"), 0.0], "f"), (0, [3.0, 1.0], "g")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, block string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).select("query_id", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), "score").collect())
    assert got == [(0, 1, 3, 2.0), (0, 1, 3, 8.0), (0, 2, -1, 1.0), (0, 2, -1, 5.0)]
