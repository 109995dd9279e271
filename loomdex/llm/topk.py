"""Exact top-k by columnar branch-and-bound.

A block of vectors is laid out dimension by dimension. Inner products are accumulated a block of dimensions at a time;
after each, what the remaining dimensions can still add is at most the product of the remaining masses (norms) of
the query and the candidate, and candidates that cannot reach the query's k-th best are dropped from the list of
survivors. The k-th best is taken from the exact scores of the k most promising after the first dimensions, so it is a
lower bound from the start. Components are integers, floor(scale * x), so scores are exact; candidates whose bound
equals the k-th best survive, so ties are whole. The k-th best of a query in one block bounds its search in all
others. Products that doubles don't hold exactly are bounded by intervals, and exact for those that survive.

Defined results: vectors that are null or have null or non-finite components take no part. Vectors of different
dimensions don't meet. A candidate with the query's id is the query's own row. Rows that repeat a vec_id are
candidates, and queries, of their own. A null vec_id is never a query and comes last among ties. Fewer than k
candidates: all. Components beyond +-2**62 are cut to it, and scores beyond a long's range likewise. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import vectors as V
from loomdex.llm.common import arrow_map, batch, materialize

SCALE = 64
K = 20
#: Stands for a score that is not known.
NONE = -(1 << 63)
#: Scores from here on may be beyond a long.
EDGE = 2.0**63 * (1 - 1e-9)
DIMS = 16


def components(data: np.ndarray, scale: float = SCALE) -> np.ndarray:
    return np.clip(np.floor(data * scale), -(2.0**62), 2.0**62).astype(np.int64)


def order_of(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, nulls, -scores))


def by_intervals(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """search_block for products beyond what doubles hold exactly: the bounds are intervals around the products in
    doubles, and only candidates whose interval reaches the k-th best get their exact product, in whole numbers."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    about = qf @ cf.T
    off = (q.shape[1] + 8) * 2.0**-52 * norm(qf)[:, None] * norm(cf)[None, :]
    for i in range(len(q)):
        at = np.flatnonzero(nulls | (ids != q_ids[i]))
        low, high = about[i, at] - off[i, at], about[i, at] + off[i, at]
        bound = max(-np.partition(-low, k - 1)[k - 1] if len(at) > k else -np.inf, float(least[i]) - 1e4 if least[i] > NONE else -np.inf)
        # scores are cut to a long's range, where they tie
        at = at[high >= (min(bound, EDGE) if bound > -EDGE else -np.inf)]
        s = np.array([min(max(int(np.dot(q[i].astype(object), c[j].astype(object))), -(2**63)), 2**63 - 1) for j in at], np.int64)
        top = np.lexsort((ids[at], nulls[at], ~s))[:k]  # ~s falls as s rises, without overflow
        yield i, at[top], s[top]


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int, dims: int = DIMS, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores) with the k best candidates of each row of q among the rows of c; least: for
    each query a score that its k-th best is known to reach (NONE: not known), under which candidates may be left out."""
    d = q.shape[1]
    least = np.full(len(q), NONE) if least is None else least
    largest = lambda x: int(np.abs(x).max(initial=0))
    reach = largest(q) * largest(c) * max(d, 1)
    if reach >= 1 << 53:  # beyond what doubles hold exactly
        yield from by_intervals(q, q_ids, c, ids, nulls, k, least)
        return
    kind = np.float32 if reach < 1 << 24 else np.float64
    cuts = list(range(0, d, dims)) + [d]
    columns = np.ascontiguousarray(c.T.astype(kind))  # vertical: a row for each dimension
    qk = q.astype(kind)
    mass = lambda x: np.stack([np.sqrt((x[:, a:].astype(np.float64) ** 2).sum(axis=1)) for a in cuts[1:]]) if len(cuts) > 1 else np.zeros((1, len(x)))
    q_mass, c_mass = mass(q), mass(c) * (1 + 1e-9) + 1e-9
    part = qk[:, : cuts[1]] @ columns[: cuts[1]] if d else np.zeros((len(q), len(c)), kind)
    own = ~nulls[None, :] & (ids[None, :] == q_ids[:, None])
    part[own] = -np.inf
    n = len(c)
    keep = min(k, n)
    lead = np.argpartition(-part, keep - 1, axis=1)[:, :keep]
    rest = np.einsum("qd,qkd->qk", q.astype(np.float64), c[lead].astype(np.float64))
    rest[np.take_along_axis(own, lead, 1)] = -np.inf
    floor = rest.min(axis=1) if n >= k else np.full(len(q), -np.inf)
    floor = np.maximum(floor, np.where(least > NONE, least.astype(np.float64), -np.inf))
    alive = part + (q_mass[0][:, None] * c_mass[0][None, :]) >= floor[:, None]
    step = 1
    # while most survive, whole blocks of dimensions are cheaper than lists of survivors
    while step < len(cuts) - 1 and alive.mean() > 0.25:
        a, b = cuts[step], cuts[step + 1]
        part += qk[:, a:b] @ columns[a:b]
        alive &= part + (q_mass[step][:, None] * c_mass[step][None, :]) >= floor[:, None]
        step += 1
    for i in range(len(q)):
        at = np.flatnonzero(alive[i] & ~own[i])
        s = part[i, at].astype(np.float64)
        for j in range(step, len(cuts) - 1):
            a, b = cuts[j], cuts[j + 1]
            s += q[i, a:b].astype(np.float64) @ columns[a:b, at]
            stay = s + q_mass[j][i] * c_mass[j][at] >= floor[i]
            at, s = at[stay], s[stay]
        if len(at) > k:  # the k-th best, with all that equal it
            stay = s >= -np.partition(-s, k - 1)[k - 1]
            at, s = at[stay], s[stay]
        top = order_of(s, ids[at], nulls[at])[:k]
        yield i, at[top], s[top].astype(np.int64)


def unpacked(x: dict, scale: float) -> tuple[np.ndarray, ...]:
    """q, q_ids, c, ids, nulls of a row of the grid."""
    dim, q_ids, ids = x["dim"], np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
    shaped = lambda data, n: components(np.frombuffer(data, np.float64).reshape(n, dim), scale)
    return shaped(x["q_data"], len(q_ids)), q_ids, shaped(x["data"], len(ids)), ids, np.frombuffer(x["nulls"], bool)


def rows_in(b: pa.RecordBatch) -> Iterator[dict]:
    for r in range(b.num_rows):
        yield {name: b.column(name)[r].as_py() for name in b.schema.names}


def floors(asked: DataFrame, blocks: DataFrame, k: int, scale: float) -> DataFrame:
    """dim, q_block, least: for each query block the k-th best score of each query in one data block, as long integers.
    It bounds the search of all other blocks, so they send few candidates instead of k each."""
    schema = pa.schema([("dim", pa.int32()), ("q_block", pa.int32()), ("least", pa.binary())])
    one = blocks.join(blocks.groupBy("dim").agg(F.min("block").alias("block")), ["dim", "block"]).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in rows_in(b):
                q, *rest = unpacked(x, scale)
                got = [s[k - 1] if len(s) == k else NONE for _, _, s in search_block(q, *rest, k)]
                yield batch(schema, [x["dim"]], [x["q_block"]], [np.array(got, np.int64).tobytes()])

    return asked.join(one, "dim").transform(arrow_map, run, "dim int, q_block int, least binary")


def top_k(table: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, block: int = 4096, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of table; queries: rows of table with an id divisible
    by 20, or those given (same columns)."""
    rows = V.rows_of(table, id_col, vector_col, zero=True)
    asked = V.sampled(rows) if queries is None else V.rows_of(queries, id_col, vector_col, zero=True)
    blocks, n = V.blocked(rows, block)
    blocks = materialize(blocks, "vector-blocks")
    asked = materialize(V.asked_blocks(V.blocked(asked, query_block)[0]), "query-blocks")
    schema = V.found_schema(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in rows_in(b):
                q, q_ids, c, ids, nulls = unpacked(x, scale)
                got = list(search_block(q, q_ids, c, ids, nulls, k, least=np.frombuffer(x["least"], np.int64)))
                counts = [len(at) for _, at, _ in got]
                row = np.repeat([i for i, _, _ in got], counts).astype(np.int32)
                at = np.concatenate([a for _, a, _ in got])
                vec = pa.array(ids[at], mask=nulls[at])
                yield batch(schema, np.full(len(row), x["dim"], np.int32), np.full(len(row), x["q_block"], np.int32), row, q_ids[row], vec, np.concatenate([s for _, _, s in got]))

    bounded = asked.join(floors(asked, blocks, k, scale), ["dim", "q_block"])
    return V.best(V.grid(bounded, blocks, n).transform(arrow_map, run, V.FOUND.format(kind="long")), k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
