"""The batched search: plan, legs, fusion, hydration and packing composed into one lazy DataFrame."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import citations, graph, lexical, retrieval
from loomdex.operators.inverted import Index
from loomdex.plans import planner

#: The weights of the derived legs, the seeds of the graph leg, and the most passages of either leg.
DISCOUNT = {"symbol": 0.9, "graph": 0.9}
SEEDS, PROPOSED = 10, 10
#: The hint for tables that grow with the corpus: by the size of their compressed files Spark would broadcast rows that are twenty
#: times as large through the driver.
MOVED = "merge"
#: Results of a call, by default and at most.
DEFAULT_K, MOST_K = 8, 50


@dataclass(frozen=True)
class Settings:
    """Optional legs ship off; a leg without its table is not built."""

    limit: int = DEFAULT_K
    hybrid: bool = False
    symbols: bool = False
    graph: bool = False
    stems: bool = True
    include_candidate: bool = False
    status: list[str] | None = None
    filters: dict[str, object] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: {"text": 1.0, "title": 3.0})
    text: str = "snippet"

    def identity(self) -> str:
        """The digest of all that decides a ranking."""
        fixed = {"k1": lexical.K1, "b": lexical.B, "stem": lexical.STEM, "rrf": retrieval.RRF_K, "depth": retrieval.DEPTH, "seeds": SEEDS, "proposed": PROPOSED, "discount": DISCOUNT, "terms": X.MAX_TERMS, "stopwords": list(X.STOPWORDS)}
        return X.digest_of({"fixed": fixed, "settings": asdict(self)})


def symbol_candidates(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """query_id, anchor, promoted, via: where the symbols that a query names are defined; only the command line's may be
    passages that other legs found as well. symbols: symbol (sym:language:name), doc_refs."""
    named = queries.select("query_id", F.explode(F.array_distinct(planner.identifiers(F.col("query")))).alias("name"), F.lit(False).alias("cli"))
    phrase = queries.select("query_id", planner.command(F.col("query")).alias("name"), F.lit(True).alias("cli")).filter("name is not null")
    known = symbols.select("symbol", F.regexp_extract("symbol", "^sym:[^:]+:(.*)$", 1).alias("name"), (F.split_part("symbol", F.lit(":"), F.lit(2)) == "cli").alias("cli"), "doc_refs").hint(MOVED)
    met = named.unionByName(phrase).join(known, ["name", "cli"]).select("query_id", "cli", "symbol", F.explode("doc_refs").alias("anchor"))
    return met.groupBy("query_id", "anchor").agg(F.max("cli").alias("promoted"), F.concat(F.lit("defines "), F.array_join(F.array_sort(F.collect_set("symbol")), ", ")).alias("via"))


def graph_candidates(seeds: DataFrame, edge_table: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """query_id, anchor, via: the passages of the nodes one step from the seeds (query_id, seed_rank, anchor)."""
    nodes = seeds.select("query_id", "seed_rank", F.posexplode(graph.nodes_of(F.col("anchor"))).alias("node_ord", "node"))
    near = graph.round_robin(nodes, edge_table, PROPOSED, MOVED)
    place = chunks.select("anchor", F.concat(F.lit("doc:"), X.document_of(F.col("anchor"))).alias("doc"), F.regexp_extract("anchor", "#(.*)/[^/]*$", 1).alias("slug")).hint(MOVED)
    met = near.withColumn("doc", F.split_part("node", F.lit("#"), F.lit(1))).withColumn("part", F.regexp_extract("node", "#(.*)$", 1)).join(place, "doc").filter("part = '' or part = slug")
    met = met.select("query_id", "anchor", "round", "seed_rank", "via")
    if symbols is not None:
        refs = symbols.select(F.col("symbol").alias("node"), F.explode("doc_refs").alias("anchor")).hint(MOVED)
        met = met.unionByName(near.join(refs, "node").select("query_id", "anchor", "round", "seed_rank", "via"))
    first = met.groupBy("query_id", "anchor").agg(F.min(F.struct("round", "seed_rank", "via")).alias("f"))
    return first.select("query_id", "anchor", F.concat_ws(" ", "f.via", F.lit("of seed"), F.col("f.seed_rank").cast("string")).alias("via"))


def add_only(candidates: DataFrame, legs: DataFrame) -> DataFrame:
    """The candidates that no leg has found yet: a derived leg adds, it doesn't promote."""
    new = candidates.join(legs.select("query_id", "anchor").distinct(), ["query_id", "anchor"], "left_anti")
    if "promoted" not in candidates.columns:
        return new
    return new.unionByName(candidates.filter("promoted")).dropDuplicates(["query_id", "anchor"])


def search(
    queries: DataFrame, docs: DataFrame, chunks: DataFrame, settings: Settings = Settings(), vector_hits: DataFrame | None = None,
    symbols: DataFrame | None = None, edges: DataFrame | None = None, related: Column | None = None, index: Index | None = None,
) -> DataFrame:
    """query_id, rank, anchor, score, n_legs, legs, ranks, via, path, status, snippet, tokens. index: a stored one of these chunks, which is
    read instead of their texts if it serves the settings.

    docs: path, doc_id, title, namespace, collection, trust, status; chunks: anchor, doc_id, text, tokens. The filter is on
    documents, before ranking, for every leg. Each query's plan says which legs it asks for, and settings which of
    them there are: the symbol leg adds definitions of names in the query, the graph leg passages one edge away from the
    best of the other legs; both are ranked by the lexical score, and neither moves what was found before. The vector
    leg is withheld from a query without a foothold. related: whether the caller asks for the graph leg.
    """
    status = retrieval.served(settings.status, settings.include_candidate)
    if status is not None and not status:
        return search(queries.limit(0), docs, chunks, Settings(include_candidate=True))
    keep = retrieval.search_filter(status=status, **settings.filters)
    of_docs = ("path", "title", "namespace", "collection", "trust", "status")
    docs = docs.hint(MOVED)
    rows = chunks.drop(*of_docs).join(docs.select("doc_id", *of_docs), "doc_id")
    placed = lexical.written(rows.select("anchor", "path", keep.alias("_keep")), "placed").hint(MOVED)
    allowed = placed.filter("_keep").select("anchor", "path")  # every leg asks for it
    if index is not None and index.serves(settings.weights, settings.stems):
        scorer = index.scorer(queries, settings.weights)
    else:
        own = set(settings.weights) <= set(chunks.columns) - set(of_docs)  # then texts needn't move to their documents
        known = placed.select(F.col("anchor").alias("key")) if own else None
        scorer = lexical.scorer(queries, lexical.index(chunks if own else rows, list(settings.weights), settings.stems, keep=False), settings.weights, settings.stems, only=known)
    depth = max(settings.limit, retrieval.DEPTH)
    words = lexical.top(scorer.best(depth, allowed.select(F.col("anchor").alias("key"))).withColumnRenamed("key", "anchor"), depth)
    legs = words.select("query_id", F.lit("lexical").alias("leg"), "anchor", "rank")
    if settings.hybrid and vector_hits is not None:
        near = vector_hits.join(allowed, "anchor", "left_semi").join(words.select("query_id").distinct(), "query_id", "left_semi")
        legs = legs.unionByName(near.select("query_id", F.lit("vector").alias("leg"), "anchor", "rank"))
    via = None
    asked = planner.plan(queries, related)
    if settings.symbols and symbols is not None:
        legs = lexical.written(legs, "legs")
        wanted = lexical.written(symbol_candidates(asked.filter(F.array_contains("generators", "symbol")), symbols).join(allowed, "anchor", "left_semi"), "named")
        new = lexical.written(add_only(wanted, legs), "new").hint(MOVED)  # a name may be defined in a part of all documents
        leg = scorer.rank(new).filter(F.col("rank") <= PROPOSED)
        legs, via = legs.unionByName(leg.select("query_id", F.lit("symbol").alias("leg"), "anchor", "rank")), wanted.select("query_id", "anchor", "via")
    if settings.graph and edges is not None:
        legs = lexical.written(legs, "legs")
        seeds = retrieval.rrf(legs, SEEDS).join(asked.filter(F.array_contains("generators", "graph")).select("query_id"), "query_id", "left_semi")
        seeds = lexical.written(seeds.select("query_id", F.col("rank").alias("seed_rank"), "anchor"), "seeds")
        wanted = lexical.written(graph_candidates(seeds, edges, chunks, symbols).join(allowed, "anchor"), "near")
        ranked = scorer.rank(add_only(wanted, legs)).join(wanted.select("anchor", "path").distinct(), "anchor")
        first = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank"))
        ranked = ranked.withColumn("_n", first).filter("_n = 1").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        legs = legs.unionByName(ranked.filter(F.col("rank") <= PROPOSED).select("query_id", F.lit("graph").alias("leg"), "anchor", "rank"))
        via = wanted.select("query_id", "anchor", "via") if via is None else via.unionByName(wanted.select("query_id", "anchor", "via"))
    fused = retrieval.rrf(legs, settings.limit, DISCOUNT)
    derived = F.exists("legs", lambda x: x.isin(*DISCOUNT))
    if via is None:
        fused = fused.withColumn("via", F.lit(None).cast("string"))
    else:
        fused = fused.join(via.groupBy("query_id", "anchor").agg(F.min("via").alias("via")), ["query_id", "anchor"], "left").withColumn("via", F.when(derived, F.col("via")))
    fused = lexical.written(fused, "fused")  # so that its size is known and no text moves to meet it
    hydrated = fused.join(chunks.select("anchor", "doc_id", "text", "tokens"), "anchor").join(docs.select("doc_id", "path", "status"), "doc_id")
    return hydrated.select("query_id", "rank", "anchor", F.round("score", 9).alias("score"), "n_legs", "legs", "ranks", "via", "path", "status", retrieval.snippet(F.col("text"), settings.text).alias("snippet"), "tokens")


def notes(queries: DataFrame, settings: Settings = Settings(), related: Column | None = None) -> DataFrame:
    """query_id, notes: what a search left out of each query and which legs its plan didn't ask for."""
    terms = F.regexp_extract_all(F.lower("query"), F.lit(f"({X.TERM})"), 1)
    planned = planner.plan(queries, related).withColumn("_all", terms).withColumn("_kept", X.query_terms(F.col("query")))
    dropped = F.array_distinct(F.filter(F.slice("_all", 1, X.MAX_TERMS), lambda t: ~F.array_contains("_kept", t)))
    unread = F.size("_all") - X.MAX_TERMS
    some = [
        F.when(unread > 0, F.concat(unread.cast("string"), F.lit(f" terms after the first {X.MAX_TERMS} were not read"))),
        F.when(F.size(dropped) > 0, F.concat(F.lit("function words were not searched: "), F.array_join(dropped, ", "))),
        F.lit(None if settings.include_candidate else "candidate documents are not served"),
        F.lit(None if settings.hybrid else "the vector leg is off"),
    ]
    for leg, on in (("symbol", settings.symbols), ("graph", settings.graph)):
        some.append(F.when(F.lit(on) & ~F.array_contains("generators", leg), F.lit(f"the plan doesn't ask for the {leg} leg")))
    return planned.select("query_id", F.filter(F.array(*some), lambda x: x.isNotNull()).alias("notes"))


def explain(queries: DataFrame, docs: DataFrame, chunks: DataFrame, settings: Settings = Settings(), related: Column | None = None, **tables: DataFrame) -> DataFrame:
    """query_id, rules, generators, notes, terms (what each reaches), candidates (with legs and ranks), settings (their
    digest): a row for each query."""
    hits = search(queries, docs, chunks, settings, related=related, **tables)
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anchor", "score", "legs", F.array_sort(F.map_entries("ranks")).alias("ranks"), "via"))).alias("candidates"))
    report = lexical.term_report(queries, chunks, stemmed=True)
    reach = report.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "documents", "rows_with", "stem", "stem_documents", "stem_rows", "stem_only", "unmatched"))).alias("terms"))
    plans = planner.plan(queries, related).select("query_id", "rules", "generators").join(notes(queries, settings, related), "query_id")
    return plans.join(reach, "query_id", "left").join(listed, "query_id", "left").withColumn("settings", F.lit(settings.identity()))


def tool(
    queries: DataFrame, docs: DataFrame, chunks: DataFrame, settings: Settings = Settings(), k: int = DEFAULT_K, budget: int | None = None,
    include_text: str = "full", related: Column | None = None, **tables: DataFrame,
) -> DataFrame:
    """query_id, rank, uri, path, status, text, score, legs, omitted, exceeded: the search as a call of its own, with bounds,
    a citation for each result, and the results that fit a token budget. omitted: the hit is over the budget; exceeded:
    not even the first hit fits, and none is served. chunks: also lines first and last, chunk_digest."""
    if not 1 <= k <= MOST_K or (budget is not None and budget < 1) or include_text not in ("full", "snippet", "none"):
        raise ValueError(f"k is 1 to {MOST_K}, a budget is positive, and text is full, snippet or none")
    chosen = Settings(**{**settings.__dict__, "limit": k, "text": include_text, "graph": settings.graph or related is not None})
    hits = search(queries, docs, chunks, chosen, related=related, **tables)
    place = chunks.select("anchor", citations.uri(F.col("anchor"), F.col("first"), F.col("last"), F.col("chunk_digest")).alias("uri"))
    out = hits.join(place, "anchor").withColumn("cost", X.token_estimate(F.col("snippet")))
    if budget is None:
        out = out.withColumn("omitted", F.lit(False)).withColumn("exceeded", F.lit(False))
    else:
        packed = retrieval.pack(out.select("query_id", "rank", "anchor", F.col("cost").alias("tokens")), budget)
        out = out.join(packed.select("query_id", "kept", "exceeded"), "query_id").withColumn("omitted", ~F.array_contains("kept", F.col("anchor")))
    return out.select("query_id", "rank", "uri", "path", "status", F.when(~F.col("omitted"), F.col("snippet")).alias("text"), "score", "legs", "omitted", "exceeded")
