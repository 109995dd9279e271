"""The record tables as a store: upserts and deletions that cascade, lookups, identities, provenance, the cache of build
results, and the doctor. Tables are values: a write returns the new table, and a snapshot publishes all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text as X


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table with rows put in, in place of those with their key."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def put_documents(tables: dict[str, DataFrame], documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Documents and their chunks: all chunks that a document had before go."""
    doomed = documents.select("doc_id").distinct()
    held = tables["chunks"].join(doomed, "doc_id", "left_anti")
    return {**tables, "documents": upsert(tables["documents"], documents, "doc_id"), "chunks": held.unionByName(chunks)}


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Without the documents, and without all rows of the other tables that name them by doc_id."""
    doomed = doc_ids.select("doc_id").distinct()
    return {name: t.join(doomed, "doc_id", "left_anti") if "doc_id" in t.columns else t for name, t in tables.items()}


def replace(tables: dict[str, DataFrame], **new: DataFrame) -> dict[str, DataFrame]:
    """Whole tables (edges, symbols, entities) in place of what was there; resolution is global, so they are made anew."""
    unknown = set(new) - set(tables)
    if unknown:
        raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
    return {**tables, **{name: rows.select(*tables[name].columns) for name, rows in new.items()}}


def put_vectors(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """vectors (chunk_digest, model_id, vector) with rows put in; one for each digest and model."""
    return upsert(vectors, rows.dropDuplicates(["chunk_digest", "model_id"]), "chunk_digest", "model_id")


def embed_worklist(chunks: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """chunk_digest, text: the distinct texts that the model has no vector for."""
    known = vectors.filter(F.col("model_id") == model_id).select("chunk_digest")
    return chunks.select("chunk_digest", "text").dropDuplicates(["chunk_digest"]).join(known, "chunk_digest", "left_anti")


def orphaned(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors of texts that no chunk has any more."""
    return vectors.join(chunks.select("chunk_digest"), "chunk_digest", "left_anti")


def has_vectors(vectors: DataFrame, model_id: str) -> bool:
    return not vectors.filter(F.col("model_id") == model_id).isEmpty()


def embed(rows: DataFrame, embedder, model_id: str, dim: int) -> DataFrame:
    """chunk_digest, model_id, vector of unit length of rows (chunk_digest, text), by any function from a list of texts to
    a matrix; it is made on each worker by calling ``embedder``, so a model is loaded where it runs."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("chunk_digest", pa.string()), ("model_id", pa.string()), ("vector", pa.list_(pa.float32()))])

    def run(batches):
        model = embedder()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = np.asarray(model(part.column(1).to_pylist()), np.float32).reshape(part.num_rows, dim)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model_id] * len(x)), pa.array(list(x), schema.field("vector").type)], schema=schema)

    return rows.select("chunk_digest", "text").mapInArrow(run, "chunk_digest string, model_id string, vector array<float>")


# Lookups


def chunks_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The chunks of the documents; order them by doc_id and ordinal."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def chunk_at(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor and its chunk, null where there is none."""
    return anchors.select("anchor").distinct().join(chunks, "anchor", "left")


def chunk_by_digest(chunks: DataFrame, digests: DataFrame) -> DataFrame:
    """chunk_digest, anchor: of the chunks of one text the first."""
    return chunks.join(digests.select("chunk_digest").distinct(), "chunk_digest", "left_semi").groupBy("chunk_digest").agg(F.min("anchor").alias("anchor"))


def symbols_by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    return symbols.join(ids.select("symbol").distinct(), "symbol", "left_semi")


# Identity and provenance


def pinned(docs: DataFrame, frontmatter_id: str = "id", mint: DataFrame | None = None) -> DataFrame:
    """docs with doc_id: what the frontmatter says; else a minted one (mint: path, doc_id), else the one that follows from the path."""
    minted = docs.withColumn("_mint", F.lit(None).cast("string")) if mint is None else docs.join(mint.select("path", F.col("doc_id").alias("_mint")), "path", "left")
    return minted.withColumn("doc_id", F.coalesce(F.col(frontmatter_id), "_mint", X.derived_ulid(F.col("path")))).drop("_mint")


def title_of(frontmatter: Column, first_heading: Column, path: Column) -> Column:
    """A document's title: its frontmatter's, else its first heading of the first level, else its file's name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(some(frontmatter), some(first_heading), name)


def trust_class(origin: Column) -> Column:
    return F.when(origin == "ingested", "ingested").otherwise("authored")


def provenance(docs: DataFrame, custody: DataFrame) -> DataFrame:
    """docs (source_digest, ...) with connector, ingested_at, fidelity_digest and secret_flags of the custody record of their
    source; a synthesis run's record gives its time and no source. custody: digest, kind, connector, first_seen, fidelity_digest, secret_flags."""
    c = custody.select(F.col("digest").alias("source_digest"), F.col("kind").alias("_kind"), F.col("connector").alias("_connector"), F.col("first_seen").alias("ingested_at"), F.col("fidelity_digest").alias("_fidelity"), F.col("secret_flags").alias("_flags"))
    run = F.col("_kind") == "synthesis"
    none = F.array().cast("array<string>")
    got = docs.join(c, "source_digest", "left").withColumn("connector", F.when(~run, F.col("_connector"))).withColumn("fidelity_digest", F.when(~run, F.col("_fidelity")))
    got = got.withColumn("secret_flags", F.coalesce(F.when(~run, F.col("_flags")), none)).withColumn("source_digest", F.when(~F.coalesce(run, F.lit(False)), F.col("source_digest")))
    return got.drop("_kind", "_connector", "_fidelity", "_flags")


# The cache of build results, restorability, and the doctor


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """cache (build_key, digest, payload) with results (build_key, payload) of keys that it lacks, under their own digests."""
    new = results.dropDuplicates(["build_key"]).join(cache.select("build_key"), "build_key", "left_anti")
    return cache.unionByName(new.select("build_key", F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("digest"), "payload"))


def cache_get(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """build_key, payload, hit: what the cache has; a payload that differs from its digest is a miss."""
    got = keys.select("build_key").distinct().join(cache, "build_key", "left")
    sound = F.coalesce(F.col("digest") == F.concat(F.lit("sha256:"), F.sha2("payload", 256)), F.lit(False))
    return got.select("build_key", F.when(sound, F.col("payload")).alias("payload"), sound.alias("hit"))


def unrestorable(states: DataFrame, blobs: DataFrame) -> DataFrame:
    """doc_id, missing: the live documents of which a blob (document_digest or chunks_digest) isn't in the inventory (digest)."""
    needs = states.select("doc_id", F.explode(F.array("document_digest", "chunks_digest")).alias("digest"))
    return needs.join(blobs.select("digest").distinct(), "digest", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("digest")).alias("missing"))


#: How grave a finding is, from the least on.
SEVERITY = ("ok", "warning", "error")


def doctor(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, custody: DataFrame, quarantined: DataFrame) -> DataFrame:
    """check, status, found: the state of the tables: chunks without a document, documents without chunks, vectors without
    a text, custody whose bytes differ from its digest, and sources in quarantine; last the worst of all, under overall.
    custody: digest, content."""
    n = lambda df, name, level: df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), F.when(F.col("found") > 0, level).otherwise("ok").alias("status"), "found")
    found = [
        n(chunks.join(documents.select("doc_id"), "doc_id", "left_anti"), "chunks without a document", "error"),
        n(documents.join(chunks.select("doc_id"), "doc_id", "left_anti"), "documents without chunks", "warning"),
        n(orphaned(vectors, chunks), "vectors without a text", "warning"),
        n(custody.filter(F.regexp_replace("digest", "^sha256:", "") != F.sha2("content", 256)), "custody that has changed", "error"),
        n(quarantined, "sources in quarantine", "warning"),
    ]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    grave = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    worst = rows.agg(F.max(grave).alias("w"), F.sum("found").alias("found")).select(F.lit("overall").alias("check"), F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("w").cast("int")).alias("status"), "found")
    return rows.unionByName(worst)
