"""A corpus of Markdown: compiled to typed tables, published as snapshots, and asked. The verbs of a command line, as methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import citations, evaluation, graph, lifecycle, store
from loomdex.operators.inverted import Index
from loomdex.plans import search as searching
from loomdex.plans.build import KEYS, REUSED, compile_documents
from loomdex.plans.report import measured
from loomdex.sources import files, frontmatter, snapshots
from loomdex.sources.snapshots import Conflict


class Corpus:
    """A folder of snapshots under root; every question is asked of the current one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.snapshots = spark, snapshots.Snapshots(spark, root)
        self.index = Index(spark, f"{root.rstrip('/')}/index", list(searching.Settings().weights))

    def table(self, name: str) -> DataFrame:
        return self.snapshots.read(name)

    def build(self, source: str | DataFrame, exclude: tuple[str, ...] = (), config: dict | None = None, whole: bool = False) -> str:
        """Compile a folder, or a table of path and text, and publish it; the snapshot's id. Of documents that are as they were in the
        current version its rows are taken over, unless the whole is asked for; if another writer publishes meanwhile, the
        build starts again on what that one made."""
        docs = files.scan(self.spark, source, exclude) if isinstance(source, str) else source
        while True:
            at = self.snapshots.current()
            reusable = at is not None and not whole and set(REUSED) <= self.snapshots.manifest(at)["tables"].keys()
            previous = (lambda name, at=at: self.snapshots.read(name, at)) if reusable else None
            try:
                return self.snapshots.publish(compile_documents(docs, X.digest_of(config or {}), previous=previous), config, KEYS, base=at)
            except Conflict:
                continue

    def plan(self, source: str | DataFrame, exclude: tuple[str, ...] = (), config: dict | None = None) -> DataFrame:
        """path, doc_id, action: what a build would do to each document."""
        docs = files.scan(self.spark, source, exclude) if isinstance(source, str) else source
        docs = docs if "source_digest" in docs.columns else docs.withColumn("source_digest", X.digest(F.col("text")))
        ids = frontmatter.frontmatter(docs).select("path", F.col("id").alias("doc_id"))
        cur = docs.join(ids, "path").select("path", "doc_id", "source_digest", F.lit(X.digest_of(config or {})).alias("env_digest"))
        return lifecycle.incremental_plan(cur, self.table("documents").select("path", "doc_id", F.col("content_digest").alias("source_digest"), "env_digest"))

    def reindex(self) -> str:
        """Bring the stored index to the current version: the chunks that differ from the version it was at, by the digest trees of
        chunks and documents, and no others. The index's version."""
        at, was = self.snapshots.current(), self.index.note().get("corpus")
        titles = self.table("documents").select("path", "title")
        rows = self.table("chunks").join(titles, "path").select("anchor", "path", "text", "title")
        if was not in self.snapshots.listed():  # nothing to compare with
            held = self.index.versions.current() and self.index._all("rows", self.index.versions.current()).select("key")
            return self.index.update(rows, held or None, note={"corpus": at})
        changed = self.snapshots.changes("chunks", was, at)
        docs = self.snapshots.changes("documents", was, at).filter("change <> 'removed'").select("path")
        some = rows.join(docs, "path", "left_semi").unionByName(rows.join(changed.filter("change <> 'removed'").select("anchor"), "anchor", "left_semi").select(*rows.columns)).dropDuplicates(["anchor"])
        return self.index.update(some, changed.filter("change = 'removed'").select(F.col("anchor").alias("key")), note={"corpus": at})

    def _index(self) -> Index | None:
        """The stored index, if it is at the current version."""
        return self.index if self.index.note().get("corpus") == self.snapshots.current() else None

    def search(self, queries: DataFrame, related: Column | None = None, vector_hits: DataFrame | None = None, **settings) -> DataFrame:
        """query_id, rank, anchor, score, ...; by the stored index where reindex() has brought it to the current version."""
        chosen = searching.Settings(**settings)
        return searching.search(queries, self.table("documents"), self.table("chunks"), chosen, vector_hits, self.table("symbols"), self.table("edges"), related, self._index())

    def search_measured(self, queries: DataFrame, vector_leg: Callable[[DataFrame], DataFrame] | None = None, related: Column | None = None, **settings) -> tuple[DataFrame, DataFrame]:
        """search() run at once, and a report of its legs: rows, seconds, and why one was left out."""
        chosen = searching.Settings(**settings)
        return measured(queries, self.table("documents"), self.table("chunks"), chosen, vector_leg, related, symbols=self.table("symbols"), edges=self.table("edges"), index=self._index())

    def explain(self, queries: DataFrame, **settings) -> DataFrame:
        return searching.explain(queries, self.table("documents"), self.table("chunks"), searching.Settings(**settings), symbols=self.table("symbols"), edges=self.table("edges"))

    def neighbors(self, targets: DataFrame, depth: int = 1, types: list[str] | None = None, limit: int | None = 20) -> DataFrame:
        """target, node, depth, or error where the target names nothing."""
        refs = graph.target_refs(targets, self.table("documents"), self.table("symbols"))
        near = graph.neighbours(refs.filter("ref is not null").select(F.col("ref").alias("origin")).distinct(), self.table("edges"), depth, types, limit)
        return refs.join(near.withColumnRenamed("origin", "ref"), "ref", "left").select("target", "node", "depth", "error")

    def show(self, uris: DataFrame, mode: str = "chunk") -> DataFrame:
        return citations.fetch_cited(uris, self.table("chunks"), mode)

    def verify(self, entailed: DataFrame, least: int = 5) -> DataFrame:
        """path, score, blockers of each synthesised document: its claims must cite, and a judge must agree. entailed: path,
        entailment."""
        made = self.table("documents").filter("origin = 'synthesized'").select("path")
        claims = self.table("nodes").filter("kind in ('paragraph', 'list_item')").join(made, "path", "left_semi").select("path", "ord", "text")
        names = self.table("documents").select(F.regexp_replace("path", r"^.*/|\.md$", "").alias("name")).unionByName(self.table("documents").select(F.col("path").alias("name")))
        return citations.grounding(citations.contract(claims, names, least), entailed)

    def promote(self, scores: DataFrame, by: str, at: str, forced: bool = False) -> str:
        return self._moved(lifecycle.promote(self.table("documents"), scores, by, at, forced=forced))

    def demote(self, paths: DataFrame) -> str:
        return self._moved(lifecycle.demote(self.table("documents"), paths))

    def _moved(self, documents: DataFrame) -> str:
        """A snapshot with these documents; what else there is stays as it is, shared with the version before."""
        at = self.snapshots.current()
        others = [n for n in self.snapshots.manifest(at)["tables"] if n != "documents"]
        return self.snapshots.publish({"documents": documents.select(*self.table("documents").columns)}, keys=KEYS, keep=others, base=at)

    def evaluate(self, cases: DataFrame, k: int = 10, **settings) -> DataFrame:
        """case_id, ndcg, recall, rr of judged cases (as from files.read_cases)."""
        asked = cases.select(F.col("case_id").alias("query_id"), "query")
        hits = self.search(asked, limit=k, **settings).select(F.col("query_id").alias("case_id"), "rank", "anchor")
        judged = cases.select("case_id", F.explode("relevant").alias("r")).select("case_id", "r.anchor", "r.grade")
        return evaluation.metrics(hits, judged, cases, k)

    def doctor(self, vectors: DataFrame | None = None, custody: DataFrame | None = None) -> DataFrame:
        no_vectors = self.spark.createDataFrame([], "chunk_digest string") if vectors is None else vectors
        no_custody = self.spark.createDataFrame([], "digest string, content string") if custody is None else custody
        return store.doctor(self.table("documents"), self.table("chunks"), no_vectors, no_custody, self.table("quarantine"))

    def export(self, path: str, source: str | DataFrame | None = None) -> None:
        """The tables as JSON lines; with the folder or table they were built from, only if that hasn't changed since."""
        now = files.scan(self.spark, source) if isinstance(source, str) else source
        tables = {n: self.table(n) for n in ("documents", "chunks", "edges", "symbols", "entities")}
        files.export_bundle(tables, {"documents": ["path"], "chunks": ["anchor"], "edges": ["edge_id"], "symbols": ["symbol"], "entities": ["slug"]}, path, now)
