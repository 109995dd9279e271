"""Approximate nearest neighbours by a robust-pruned directed graph.

Rows are dealt to shards of bounded size and each shard builds its own graph. Every vector searches the graph so
far, from its medoid, for its neighbours; of those it meets, robust pruning keeps the nearest and drops each that a
kept one is nearer to by the factor alpha, so that edges point in diverse directions; reverse edges are added and
lists that grow too long are pruned likewise. Two passes, the second with alpha above 1. A query beam-searches
every shard and the shards' answers are merged; scores are the inner products of the original vectors in doubles.

Nearness is the inner product: one more dimension brings all vectors of a shard to one length, which makes the
largest inner product the smallest distance. How wide a beam this takes depends on the lengths: a few dozen nodes for
vectors of one length, far more where lengths differ. So each shard tries its graph on some of its own vectors as
queries, doubles its beam until it finds RECALL of their true nearest, and keeps that beam with the graph; where only
a beam of all nodes is wide enough the shard is read whole. Equal vectors of a shard are one node with a list of ids, so copies cost
no edges and ties are whole.

Defined results: vectors that are null, zero or have null or non-finite components take no part. Vectors of different
dimensions don't meet. A candidate with the query's id is the query's own row. Rows that repeat a vec_id are
candidates, and queries, of their own. A null vec_id is never a query and comes last among ties. Fewer than k
candidates: all of them, by reading them all (as in any shard of no more distinct vectors than its beam). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import vectors as V
from loomdex.llm.common import arrow_map, batch, materialize

K = 20
SHARD = 8192
DEGREE = 48
BUILD_BEAM = 64
BEAM = 96
#: What share of the nearest a shard's beam has to find, of so many of its own vectors as queries.
RECALL, TRIALS = 0.95, 64
ALPHA = 1.2
STEP = 4  # nodes of each beam that are opened at once


def augmented(x: np.ndarray) -> np.ndarray:
    """x scaled to at most length 1, with one more dimension that brings each row to length 1."""
    scale = np.abs(x).max(initial=0)
    x = x / (scale if scale > 0 else 1)
    norm = (x * x).sum(axis=1)
    top = norm.max(initial=0)
    rest = np.sqrt(np.maximum(top - norm, 0))
    return (np.column_stack([x, rest]) / np.sqrt(top if top > 0 else 1)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's beam, best first; -1 where there are fewer. All queries advance together."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)  # column n stands for no node
    seen[:, [entry, n]] = True
    nodes = np.full((b, beam), n, np.int64)
    nodes[:, 0] = entry
    near = np.full((b, beam), -np.inf, np.float32)
    near[:, 0] = q @ x[entry]
    opened = np.ones((b, beam), bool)
    opened[:, 0] = False
    rows = np.arange(b)
    live = rows
    while len(live):
        # the first `step` of each beam that aren't open yet
        order = np.argsort(opened[live], axis=1, kind="stable")[:, :step]
        fresh = ~np.take_along_axis(opened[live], order, 1)
        picked = np.where(fresh, np.take_along_axis(nodes[live], order, 1), n)
        opened[live[:, None], order] = True
        around = graph[picked].reshape(len(live), -1)  # graph has a row of n at n
        around.sort(axis=1)
        repeat = np.zeros_like(around, bool)
        repeat[:, 1:] = around[:, 1:] == around[:, :-1]
        around[repeat | seen[live[:, None], around]] = n
        seen[live[:, None], around] = True
        real = around < n
        sims = np.full(around.shape, -np.inf, np.float32)
        r, c = np.nonzero(real)
        sims[r, c] = np.einsum("kd,kd->k", x[around[r, c]], q[live[r]])
        all_sims = np.concatenate([near[live], sims], axis=1)
        all_nodes = np.concatenate([nodes[live], around], axis=1)
        all_open = np.concatenate([opened[live], ~real], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sims, top, 1), axis=1, kind="stable"), 1)
        near[live], nodes[live], opened[live] = (np.take_along_axis(a, top, 1) for a in (all_sims, all_nodes, all_open))
        live = live[~opened[live].all(axis=1)]
    return np.where(nodes < n, nodes, -1), near


def robust_prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (len(x) for none), diverse; at: the nodes the rows belong to."""
    n = len(x)
    pad = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == at[:, None]] = n
    vec = pad[candidates]
    to_p = 1 - np.einsum("bkd,bd->bk", vec, x[at])  # half the squared distance, as all have length 1
    to_p[candidates == n] = np.inf
    order = np.argsort(to_p, axis=1, kind="stable")
    candidates, to_p = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_p, order, 1)
    vec = np.take_along_axis(vec, order[:, :, None], 1)
    between = 1 - vec @ vec.transpose(0, 2, 1)
    alive = np.isfinite(to_p)
    out = np.full((len(at), degree), n, np.int64)
    rows = np.arange(len(at))
    for j in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        first = alive.argmax(axis=1)
        out[any_left, j] = candidates[rows, first][any_left]
        alive &= ~(alpha * alpha * between[rows, first] <= to_p)
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7, lot: int = 256) -> tuple[np.ndarray, int]:
    """(graph with a last row for no node, entry) over the rows of x, which are distinct and of length 1."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n + 1, degree), n, np.int64)
    if n > 1:
        graph[:n, : min(degree // 2, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(degree // 2, n - 1)))) % n
    entry = int(np.argmax(x @ x.mean(axis=0))) if n else 0
    for a in (1.0, alpha) if n > 1 else ():
        order = rng.permutation(n)
        for lo in range(0, n, lot):
            at = order[lo : lo + lot]
            met, _ = beam_search(x, graph, entry, x[at], beam)
            met[met < 0] = n
            graph[at] = robust_prune(x, at, np.concatenate([met, graph[at]], axis=1), degree, a)
            _reverse(x, graph, at, degree, a)
    return graph, entry


def _reverse(x: np.ndarray, graph: np.ndarray, at: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges back to the nodes in at; prune the lists that grow over the degree."""
    n = len(x)
    to, source = graph[at].ravel(), np.repeat(at, degree)
    real = to < n
    to, source = to[real], source[real]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    for lo in range(0, len(to), 4096):  # bounded memory
        t, s = to[lo : lo + 4096], source[lo : lo + 4096]
        heads, first, count = np.unique(t, return_index=True, return_counts=True)
        extra = np.full((len(heads), count.max()), n, np.int64)
        extra[np.repeat(np.arange(len(heads)), count), np.arange(len(t)) - np.repeat(first, count)] = s
        both = np.sort(np.concatenate([graph[heads], extra], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        both.sort(axis=1)
        fits = (both < n).sum(axis=1) <= degree
        graph[heads[fits]] = both[fits, :degree]
        for k in range(0, int((~fits).sum()), 512):
            some = np.flatnonzero(~fits)[k : k + 512]
            graph[heads[some]] = robust_prune(x, heads[some], both[some], degree, alpha)


def beam_for(x: np.ndarray, graph: np.ndarray, entry: int, k: int, beam: int, seed: int) -> int:
    """The beam, or its double as often as needed, that finds RECALL of the k nearest of TRIALS rows of x."""
    n, rng = len(x), np.random.default_rng(seed)
    if n <= beam:
        return beam
    own = rng.choice(n, min(TRIALS, n), replace=False)
    q, k = x[own], min(k, n - 1)
    scores = q @ x.T
    scores[np.arange(len(own)), own] = -np.inf
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    x_all, flat = augmented(x), unit_queries(q)
    while beam < n:
        nodes, _ = beam_search(x_all, graph, entry, flat, beam, opened_at_once(beam))
        near = np.where(nodes >= 0, np.take_along_axis(scores, np.maximum(nodes, 0), 1), -np.inf) >= least[:, None]
        if np.minimum(near.sum(axis=1), k).mean() >= RECALL * k:
            break
        beam *= 2
    return beam


def unit_queries(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.zeros(len(q))]).astype(np.float32)


def opened_at_once(beam: int) -> int:
    return max(STEP, beam // 24)


INDEX = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("data", pa.binary()), ("ends", pa.binary()), ("graph", pa.binary()), ("entry", pa.int32()), ("beam", pa.int32())])
INDEX_SQL = "dim int, block int, ids binary, nulls binary, data binary, ends binary, graph binary, entry int, beam int"


def to_index(blocks: DataFrame, degree: int = DEGREE, beam: int = BEAM, k: int = K, alpha: float = ALPHA) -> DataFrame:
    """A row for each shard: the distinct vectors, the ids of each (by id), the graph, its entry and the beam it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, block, ids, nulls, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
                x, of = np.unique(np.frombuffer(data, np.float64).reshape(len(ids), dim), axis=0, return_inverse=True)
                order = np.lexsort((ids, nulls, of.ravel()))
                ends = np.cumsum(np.bincount(of.ravel(), minlength=len(x)))
                graph, entry = build(augmented(x), degree, BUILD_BEAM, alpha, seed=block)
                wide = beam_for(x, graph, entry, k, beam, block)
                yield batch(INDEX, [dim], [block], [ids[order].tobytes()], [nulls[order].tobytes()], [x.tobytes()], [ends.astype(np.int64).tobytes()], [graph.astype(np.int32).tobytes()], [entry], [wide])

    return blocks.transform(arrow_map, run, INDEX_SQL)


def search_shard(shard: dict, q: np.ndarray, q_ids: np.ndarray, k: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, whether it is null, score) of up to k candidates found for each query."""
    dim, ids, nulls = shard["dim"], np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["nulls"], bool)
    x = np.frombuffer(shard["data"], np.float64).reshape(-1, dim)
    ends = np.frombuffer(shard["ends"], np.int64)
    graph = np.frombuffer(shard["graph"], np.int32).reshape(-1, degree).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    beam = max(shard["beam"], 2 * k)
    if len(x) <= beam:  # fewer than a beam holds: all of them
        nodes = np.tile(np.arange(len(x)), (len(q), 1))
    else:
        nodes, _ = beam_search(augmented(x), graph, shard["entry"], unit_queries(q), beam, opened_at_once(beam))
    out_row, out_at, out_score = [], [], []
    for i, found in enumerate(nodes):
        found = found[found >= 0]
        scores = (x[found] * q[i]).sum(axis=1)
        order = np.argsort(-scores, kind="stable")
        at, to = [], []
        for f, s in zip(found[order], scores[order], strict=True):
            if len(at) > k and s < to[-1]:
                break
            members = np.arange(begins[f], ends[f])
            members = members[nulls[members] | (ids[members] != q_ids[i])][:k]
            at += members.tolist()
            to += [s] * len(members)
        at, to = np.array(at, np.int64), np.array(to)
        top = np.lexsort((ids[at], nulls[at], -to))[:k]
        out_row.append(np.full(len(top), i, np.int32))
        out_at.append(at[top])
        out_score.append(to[top])
    at = np.concatenate(out_at)
    return np.concatenate(out_row), ids[at], nulls[at], np.concatenate(out_score)


def nearest(table: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of up to k rows of table for each query; queries: rows of table with an id
    divisible by 20, or those given (same columns)."""
    rows = V.rows_of(table, id_col, vector_col, zero=False)
    asked = V.sampled(rows) if queries is None else V.rows_of(queries, id_col, vector_col, zero=False)
    blocks, n = V.blocked(rows, shard)
    index = materialize(to_index(materialize(blocks, "vector-blocks"), degree, beam, k), "graph-index")
    schema = V.found_schema(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {name: b.column(name)[r].as_py() for name in b.schema.names}
                q_ids = np.frombuffer(x["q_ids"], np.int64)
                q = np.frombuffer(x["q_data"], np.float64).reshape(len(q_ids), x["dim"])
                row, ids, nulls, scores = search_shard(x, q, q_ids, k, degree)
                yield batch(schema, np.full(len(row), x["dim"], np.int32), np.full(len(row), x["q_block"], np.int32), row, q_ids[row], pa.array(ids, mask=nulls), scores)

    pairs = V.grid(V.asked_blocks(V.blocked(asked, query_block)[0]), index, n)
    return V.best(pairs.transform(arrow_map, run, V.FOUND.format(kind="double")), k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
