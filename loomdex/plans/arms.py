"""The arms that an evaluation compares: the same search with other settings, and the baseline without an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import evaluation, lexical
from loomdex.plans.search import Settings, search

ARMS = {
    "default": {}, "lexical": {"hybrid": False, "graph": False, "symbols": False}, "hybrid": {"hybrid": True}, "graph": {"graph": True}, "graph-every-query": {"graph": True}, "symbol": {"symbols": True},
}


def retrieve(arm: str, queries: DataFrame, docs: DataFrame, chunks: DataFrame, limit: int = 50, **tables: DataFrame) -> DataFrame:
    """case_id, rank, anchor by one arm: grep, or one of ARMS; tables: vector_hits, symbols, edges, as far as the arm needs them."""
    if arm == "grep":
        return lexical.grep(queries, chunks, limit).select(F.col("query_id").alias("case_id"), "rank", "anchor")
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm}; there are grep, {', '.join(ARMS)}")
    related = F.lit(True) if arm == "graph-every-query" else None
    return search(queries, docs, chunks, Settings(limit=limit, **ARMS[arm]), related=related, **tables).select(F.col("query_id").alias("case_id"), "rank", "anchor")


def compare(arms: list[str], queries: DataFrame, judged: DataFrame, cases: DataFrame, docs: DataFrame, chunks: DataFrame, **tables: DataFrame) -> DataFrame:
    """arm, case_id, ndcg, recall, rr of every arm on every answerable case."""
    out = None
    for arm in arms:
        one = evaluation.metrics(retrieve(arm, queries, docs, chunks, **tables), judged, cases).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one)
    return out
