"""A search that is run at once, with what each leg gave, how long it took, and which leg had to be left out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomdex.functions.work import written
from loomdex.plans.search import Settings, search

LEGS = "lexical", "vector", "symbol", "graph"
#: Characters of an error that a note holds.
NOTE = 200


def told(error: Exception) -> str:
    """The class and first line of an error."""
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"[:NOTE]


def measured(
    queries: DataFrame, docs: DataFrame, chunks: DataFrame, settings: Settings = Settings(), vector_leg: Callable[[DataFrame], DataFrame] | None = None,
    related: Column | None = None, **tables: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(the hits of search(), a report: leg, state, rows, seconds, note).

    vector_leg: makes the vector hits (query_id, anchor, rank) of the queries; it is run for itself first, and if it fails, on the
    driver or in a task, the search goes on without it. Rows of a leg are its passages among the hits, counted by an
    observation while the hits are written, so nothing is read twice. seconds: of the vector leg, and of the search as a whole in
    the row ``hits``; null for legs that the search computes with others. state: ok, failed or off.
    """
    state = dict.fromkeys(LEGS, "off") | {"lexical": "ok"}
    notes: dict[str, str] = {}
    seconds: dict[str, float] = {}
    near = None
    if settings.hybrid and vector_leg is not None:
        began = time.perf_counter()
        try:
            near = written(vector_leg(queries).select("query_id", "anchor", "rank"), "vector-leg")
            state["vector"] = "ok"
        except Exception as e:  # whatever an embedder raises: the other legs don't depend on it
            state["vector"], notes["vector"] = "failed", told(e)
        seconds["vector"] = time.perf_counter() - began
    for leg, on, needs in (("symbol", settings.symbols, "symbols"), ("graph", settings.graph, "edges")):
        if on and tables.get(needs) is not None:
            state[leg] = "ok"
        elif on:
            notes[leg] = f"there is no table of {needs}"
    seen = Observation()
    of = {leg: F.array_contains("legs", leg) for leg in LEGS} | {"hits": F.lit(True)}
    began = time.perf_counter()
    hits = search(queries, docs, chunks, settings, near, related=related, **tables)
    counts = [F.count_if(c).alias(leg) for leg, c in of.items()]
    hits = written(hits.observe(seen, *counts), "hits")
    seconds["hits"] = time.perf_counter() - began
    got = seen.get
    rows = [(leg, state.get(leg, "ok"), got[leg], seconds.get(leg), notes.get(leg)) for leg in of]
    return hits, queries.sparkSession.createDataFrame(rows, "leg string, state string, rows long, seconds double, note string")
