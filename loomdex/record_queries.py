"""More queries of the registry: derived legs, typed edges, the store, gates, re-rankers, chats and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions import work
from loomdex.functions.work import written
from loomdex.operators import chats, citations, evaluation, graph, lexical, lifecycle, retrieval, store, symbols
from loomdex.plans.report import measured
from loomdex.plans.search import Settings, add_only, graph_candidates, notes, search, symbol_candidates, tool
from loomdex.queries import _GREP, _MSG, _SLICED, ASKED, ORACLES, _asked, _bm25_sql, _cases, _corpus, _labelled, _messages, _rows, _slices, query
from loomdex.sources import files, frontmatter, html, markdown, markup, snapshots
from loomdex.sources.tables import table

# Derived legs: every third item asks for what is related, every second names an identifier. An identifier's symbol is
# defined in the first chunk of each document that it numbers; each document links to the one with the next id.


def _led(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit(" pkg.item_"), (F.col("query_id") % 50).cast("string"))).otherwise("")
    near = F.when(F.col("query_id") % 3 == 0, " related to").otherwise("")
    return _asked(spark, sf_dir).withColumn("query", F.concat("query", near, named))


def _leg_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, symbols, edges)."""
    docs, chunks = _corpus(spark, sf_dir)
    first = chunks.filter("ordinal = 0").groupBy(F.concat(F.lit("sym:python:pkg.item_"), (F.col("doc_id") % 50).cast("string")).alias("symbol")).agg(F.array_sort(F.collect_set("anchor")).alias("doc_refs"))
    to = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("to_path"))
    edges = graph.edges(docs.select("doc_id", "path").join(to, "doc_id").select("path", "to_path", F.lit(0).cast("long").alias("ord")))
    return docs, chunks, first, edges


def _scored(spark: SparkSession, sf_dir: str) -> tuple[lexical.Scorer, DataFrame]:
    """(scorer of the texts, the lexical leg)."""
    rows = _corpus(spark, sf_dir)[1]
    scorer = lexical.scorer(_led(spark, sf_dir), lexical.index(rows, ["text"], keep=False), {"text": 1.0})
    return scorer, lexical.top(scorer.best(retrieval.DEPTH).withColumnRenamed("key", "anchor"), retrieval.DEPTH).withColumn("leg", F.lit("lexical"))


_LED = ASKED.replace("FROM benchmark)", "FROM (SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ' related to' ELSE '' END || CASE WHEN item_id % 2 = 0 THEN ' pkg.item_' || (item_id % 50) ELSE '' END AS text FROM benchmark))")
# a term of several index tokens is a phrase; the only one here is item_<n>, and pkg stands alone
_LEGS = _bm25_sql(False).replace(ASKED, _LED).rsplit("SELECT query_id, anchor, round(score, 6)", 1)[0].rstrip()
_LEGS = (
    _LEGS.replace("a AS (SELECT query_id, unnest(terms) AS t FROM asked)", "a AS (SELECT query_id, unnest(terms) AS t FROM asked), solo AS (SELECT * FROM a WHERE NOT starts_with(t, 'item_'))").replace("[1] AS term FROM a)", "[1] AS term FROM solo)")
    + """, lex AS (SELECT * FROM r WHERE rank <= 50),
symc AS (SELECT DISTINCT b.item_id AS query_id, c.anchor FROM benchmark b JOIN chunks c ON c.ordinal = 0 AND b.item_id % 2 = 0 AND c.doc_id % 50 = b.item_id % 50),
symr AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.anchor) AS n FROM s JOIN symc USING (query_id, anchor) WHERE (s.query_id, s.anchor) NOT IN (SELECT (query_id, anchor) FROM lex)),
sym AS (SELECT query_id, anchor, score, CAST(n AS INTEGER) AS rank FROM symr WHERE n <= 10),
ed AS (SELECT a.path AS a, b.path AS b FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1),
inc AS (SELECT a AS node, b AS other, 0 AS dir FROM ed UNION ALL SELECT b, a, 1 FROM ed)"""
)


def _graph_sql(seeds: str, found: str) -> str:
    return f""", walk AS (SELECT z.query_id, z.rank AS seed_rank, i.other, row_number() OVER (PARTITION BY z.query_id, z.rank ORDER BY i.dir, 'doc:' || i.other) AS round
  FROM ({seeds}) z JOIN inc i ON i.node = split_part(z.anchor, '#', 1) WHERE z.query_id % 3 = 0),
prop AS (SELECT query_id, other, min((round, seed_rank)) AS spot FROM walk GROUP BY 1, 2), pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, 'doc:' || other) AS n FROM prop),
gc AS (SELECT p.query_id, c.anchor, c.path FROM pr p JOIN chunks c ON c.path = p.other WHERE p.n <= 10),
gs AS (SELECT gc.*, s.score FROM gc JOIN s USING (query_id, anchor) WHERE (query_id, anchor) NOT IN (SELECT (query_id, anchor) FROM ({found}))),
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, anchor) AS n FROM gs),
g2 AS (SELECT query_id, anchor, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS INTEGER) AS rank FROM g1 WHERE n = 1), gr AS (SELECT * FROM g2 WHERE rank <= 10)"""


@query(_LEGS + " SELECT query_id, anchor, round(score, 6) AS score, rank FROM sym")
def symbol_leg(spark, sf_dir):
    docs, chunks, symbols, _ = _leg_tables(spark, sf_dir)
    scorer, lex = _scored(spark, sf_dir)
    wanted = symbol_candidates(_led(spark, sf_dir), symbols)
    return scorer.rank(add_only(wanted, lex)).filter(F.col("rank") <= 10).withColumn("score", F.round(F.round("score", 9), 6)).select("query_id", "anchor", "score", "rank")


@query(_LEGS + _graph_sql("SELECT * FROM lex WHERE rank <= 10", "SELECT * FROM lex") + " SELECT query_id, anchor, round(score, 6) AS score, rank FROM gr")
def graph_leg(spark, sf_dir):
    _, chunks, _, edges = _leg_tables(spark, sf_dir)
    scorer, lex = _scored(spark, sf_dir)
    seeds = lex.filter("rank <= 10 and query_id % 3 = 0").select("query_id", F.col("rank").alias("seed_rank"), "anchor")
    ranked = scorer.rank(add_only(graph_candidates(seeds, edges, chunks), lex)).withColumn("path", X.document_of(F.col("anchor")))
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank"))).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("rank", place).filter("rank <= 10").withColumn("score", F.round(F.round("score", 9), 6)).select("query_id", "anchor", "score", "rank")


@query(_LEGS + """, f1 AS (SELECT query_id, anchor, sum(CAST(round(1.0::DOUBLE / (60 + rank), 12) AS DECIMAL(20, 12))) AS score FROM (SELECT query_id, anchor, rank FROM lex UNION ALL SELECT query_id, anchor, rank FROM sym) GROUP BY 1, 2),
seed AS (SELECT query_id, anchor, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS rank FROM f1)""" + _graph_sql("SELECT * FROM seed WHERE rank <= 10", "SELECT query_id, anchor FROM lex UNION ALL SELECT query_id, anchor FROM sym") + """,
legs AS (SELECT query_id, anchor, 1.0::DOUBLE / (60 + rank) AS part FROM lex UNION ALL SELECT query_id, anchor, 0.9::DOUBLE / (60 + rank) FROM sym UNION ALL SELECT query_id, anchor, 0.9::DOUBLE / (60 + rank) FROM gr),
fu AS (SELECT query_id, anchor, sum(CAST(round(part, 12) AS DECIMAL(20, 12))) AS score, count(*) AS n_legs FROM legs GROUP BY 1, 2),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS INTEGER) AS rank FROM fu)
SELECT query_id, rank, anchor, round(CAST(score AS DOUBLE), 9) AS score, n_legs FROM fr WHERE rank <= 20""")  # fmt: skip
def search_planned(spark, sf_dir):
    docs, chunks, symbols, edges = _leg_tables(spark, sf_dir)
    settings = Settings(limit=20, symbols=True, graph=True, stems=False, include_candidate=True, weights={"text": 1.0})
    return search(_led(spark, sf_dir), docs, chunks, settings, symbols=symbols, edges=edges).select("query_id", "rank", "anchor", "score", "n_legs")


@query(f"""WITH hits AS ({ORACLES["search_planned"]}) SELECT 'hits' AS leg, 'ok' AS state, count(*) AS rows FROM hits UNION ALL SELECT 'vector', 'failed', 0""")
def search_degraded(spark, sf_dir):
    """The planned search with an embedder that can't be reached: every hit of the other legs, and the failure told."""
    docs, chunks, symbols, edges = _leg_tables(spark, sf_dir)
    docs, chunks = docs.drop("text"), chunks.select("anchor", "doc_id", "text", "tokens")  # all that a search reads
    docs, chunks, symbols, edges = (written(t, "leg-table") for t in (docs, chunks, symbols, edges))  # as a store holds them
    settings = Settings(limit=20, hybrid=True, symbols=True, graph=True, stems=False, include_candidate=True, weights={"text": 1.0})
    unreachable = lambda asked: asked.select("query_id", F.col("query").alias("anchor"), F.raise_error(F.lit("no embedder")).cast("int").alias("rank"))
    _, legs = measured(_led(spark, sf_dir), docs, chunks, settings, unreachable, symbols=symbols, edges=edges)
    return legs.filter("leg in ('hits', 'vector')").select("leg", "state", "rows")


_PHRASES = "w AS (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM benchmark), q AS (SELECT item_id AS query_id, array_to_string(ws[1:3], ' ') AS query FROM w)"


@query(_bm25_sql(False, "nt = all_t").replace("@CORPUS@, rowz", "@CORPUS@, w AS (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM benchmark), short AS (SELECT item_id, array_to_string(ws[1:3], ' ') AS text FROM w), rowz").replace(ASKED, ASKED.replace("FROM benchmark)", "FROM short)")).replace("b AS (SELECT query_id,", "c AS (SELECT query_id, count(DISTINCT t) AS all_t FROM a GROUP BY 1), b AS (SELECT query_id,").replace("s AS (SELECT query_id, anchor, round(sum(", "m AS (SELECT query_id, anchor, count(DISTINCT term) AS nt FROM b JOIN f USING (term) GROUP BY 1, 2), s AS (SELECT query_id, anchor, round(sum(").replace("CROSS JOIN st WHERE", "CROSS JOIN st JOIN m USING (query_id, anchor) JOIN c USING (query_id) WHERE"))
def search_match_all(spark, sf_dir):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(f"({X.TERM})"), 1), 1, 3)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
    return lexical.bm25(asked, _rows(spark, sf_dir), {"text": 1.0}, 10, mode="all")


# Edges of notes: documents in three folders, each linking to the next one's path, every second to a heading of it


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    folder = F.element_at(F.array(F.lit("evidence"), F.lit("candidate"), F.lit("verified"), F.lit("notes")), (F.col("doc_id") % 4 + 1).cast("int"))
    origin = F.element_at(F.array(*map(F.lit, ("ingested", "synthesized", "authored", "authored", "authored"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), origin.alias("origin"))


def _note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    to = notes.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("target"))
    fragment = F.when(F.col("doc_id") % 2 == 0, "#Top").otherwise("")
    links = notes.join(to, "doc_id").select("path", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("/"), "target", fragment).alias("target"), F.lit("wikilink").alias("kind"))
    resolved = graph.resolve(links, notes)
    return graph.fragments(resolved, notes.filter("doc_id % 3 = 0").select("path", F.lit("top").alias("slug")), X.slug(F.col("_fragment")))


_NOTES = """notes AS (SELECT doc_id, ['evidence', 'candidate', 'verified', 'notes'][doc_id % 4 + 1] || '/' || doc_id || '.md' AS path, ['ingested', 'synthesized', 'authored', 'authored', 'authored'][doc_id % 5 + 1] AS origin FROM documents),
ln AS (SELECT a.path, a.origin, b.path AS to_path, a.doc_id % 2 = 0 AND b.doc_id % 3 = 0 AS section, a.doc_id % 2 = 0 AND b.doc_id % 3 <> 0 AS lost FROM notes a JOIN notes b ON b.doc_id = a.doc_id + 1),
st AS (SELECT origin, path, CASE WHEN origin = 'ingested' THEN 'extracted' ELSE 'authored' END AS status FROM notes),
l1 AS (SELECT 'doc:' || path AS source, 'doc:' || to_path || CASE WHEN section THEN '#top' ELSE '' END AS target, CASE WHEN starts_with(to_path, 'evidence/') AND NOT starts_with(path, 'evidence/') THEN 'cites' ELSE 'links_to' END AS type,
  CASE WHEN origin = 'ingested' THEN 'extracted' ELSE 'authored' END AS status, 'wikilink' AS provenance, origin FROM ln),
l2 AS (SELECT 'doc:' || a.path, 'doc:' || b.path, 'supersedes', CASE WHEN a.origin = 'ingested' THEN 'extracted' ELSE 'authored' END, 'frontmatter' FROM notes a JOIN notes b ON b.doc_id = a.doc_id + 2 WHERE a.doc_id % 7 = 0),
l3 AS (SELECT DISTINCT target, split_part(target, '#', 1), 'part_of', 'authored', 'heading' FROM l1 WHERE contains(target, '#')),
l4 AS (SELECT DISTINCT source, split_part(target, '#', 1), 'derived_from', 'authored', 'frontmatter' FROM l1 WHERE type = 'cites' AND origin = 'synthesized'),
every AS (SELECT source, target, type, status, provenance FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3 UNION SELECT * FROM l4)"""


@query(f"""WITH {_NOTES} SELECT 'sha256:' || sha256('[' || to_json(source)::VARCHAR || ',' || to_json(target)::VARCHAR || ',"' || type || '","sha256:' || sha256('{{"anchor":null,"kind":"' || provenance || '"}}') || '"]') AS edge_id, source, target, type, status, provenance FROM every""")
def typed_edges(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    origins = notes.select("path", "origin")
    links = graph.edges(_note_links(spark, sf_dir), origins)
    to = notes.select((F.col("doc_id") - 2).alias("doc_id"), F.col("path").alias("target"))
    declared = notes.filter("doc_id % 7 = 0").select("doc_id", "path").join(to, "doc_id").select("path", "target")
    every = graph.merge_edges(links, graph.supersedes(declared, notes, origins), graph.part_of(links), graph.derived_from(links, origins))
    return every.select("edge_id", "source", "target", "type", "status", "provenance")


@query(f"WITH {_NOTES} SELECT CASE WHEN lost THEN 'no such heading' ELSE 'resolved' END AS reason, count(*) AS links, count(*) FILTER (WHERE section) AS sections FROM ln GROUP BY 1")
def link_fragments(spark, sf_dir):
    return _note_links(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("links"), F.count("to_section").alias("sections"))


@query(f"""WITH {_NOTES} SELECT path AS target, 'doc:' || path AS ref, NULL AS error FROM notes UNION ALL SELECT 'sym:python:pkg.f_' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sym:python:pkg.f_' || doc_id END, CASE WHEN doc_id % 2 = 1 THEN 'no such symbol' END FROM documents
UNION ALL SELECT 'gone/' || doc_id || '.md#a/0', NULL, 'no such document' FROM documents UNION ALL SELECT 'doc:' || path || '#top', 'doc:' || path || '#top', NULL FROM notes""")
def target_refs(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    name = lambda mark, tail="": F.concat(F.lit(mark), F.col("doc_id").cast("string"), F.lit(tail))
    asked = notes.select(F.col("path").alias("target")).unionByName(notes.select(name("sym:python:pkg.f_").alias("target"))).unionByName(notes.select(name("gone/", ".md#a/0").alias("target"))).unionByName(notes.select(F.concat(F.lit("doc:"), "path", F.lit("#top")).alias("target")))
    return graph.target_refs(asked, notes, notes.filter("doc_id % 2 = 0").select(name("sym:python:pkg.f_").alias("symbol")))


# The store


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, chunks = _corpus(spark, sf_dir)
    return {"documents": docs.select("doc_id", "path", "status"), "chunks": chunks.select("anchor", "doc_id", "ordinal", "text", "chunk_digest")}


@query("""WITH @CORPUS@, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'candidate' ELSE d.status END AS status, CAST(CASE WHEN d.doc_id % 10 = 0 THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS chunks FROM docs d LEFT JOIN n USING (doc_id) WHERE d.doc_id % 10 <> 5""")
def store_put_delete(spark, sf_dir):
    """Every tenth document is put again with one chunk, and every tenth one is deleted with all its chunks."""
    tables = _store(spark, sf_dir)
    again = tables["documents"].filter("doc_id % 10 = 0").withColumn("status", F.lit("candidate"))
    text = F.concat(F.lit("rewritten "), F.col("doc_id").cast("string"))
    chunk = again.select(F.concat("path", F.lit("#/0")).alias("anchor"), "doc_id", F.lit(0).cast("long").alias("ordinal"), text.alias("text"), X.digest(text).alias("chunk_digest"))
    new = store.delete_documents(store.put_documents(tables, again, chunk), tables["documents"].filter("doc_id % 10 = 5").select("doc_id"))
    n = new["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return new["documents"].join(n, "doc_id", "left").select("doc_id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("WITH @CORPUS@ SELECT 'sha256:' || sha256(text) AS chunk_digest, min(anchor) AS anchor FROM chunks WHERE ordinal = 0 OR text IN (SELECT text FROM chunks WHERE ordinal = 0) GROUP BY 1")
def chunk_by_digest(spark, sf_dir):
    chunks = _corpus(spark, sf_dir)[1]
    return store.chunk_by_digest(chunks, chunks.filter("ordinal = 0"))


@query("WITH @CORPUS@, v AS (SELECT DISTINCT sha256(text) AS d FROM chunks WHERE ordinal % 2 = 0) SELECT DISTINCT 'sha256:' || sha256(text) AS chunk_digest FROM chunks WHERE sha256(text) NOT IN (SELECT d FROM v)")
def embed_worklist(spark, sf_dir):
    """The texts of which an even chunk has no vector yet."""
    chunks = _corpus(spark, sf_dir)[1]
    held = chunks.filter("ordinal % 2 = 0").select("chunk_digest", F.lit("m").alias("model_id"))
    return store.embed_worklist(chunks, held, "m").select("chunk_digest")


@query("""WITH h AS (SELECT doc_id, sha256('doc/' || doc_id) AS h FROM documents)
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'PINNED' || doc_id ELSE '0000000000' || list_aggregate(list_transform(range(16), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ',
  1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') END AS doc_id FROM h""")
def pinned_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("PINNED"), F.col("doc_id").cast("string"))).alias("id"))
    return store.pinned(d).select(F.col("n").alias("id"), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 3 THEN NULL ELSE 'file' END AS connector, CASE WHEN doc_id % 4 = 3 THEN -1 ELSE doc_id * 2 END AS ingested_at, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'sha256:' || sha256(text) END AS source_digest FROM documents""")
def custody_provenance(spark, sf_dir):
    """Every fourth document comes from a synthesis run, every fourth has no custody record."""
    d = table(spark, sf_dir, "documents")
    docs = d.select("doc_id", X.digest(F.col("text")).alias("text_digest"), F.concat(X.digest(F.col("text")), F.lit("/"), F.col("doc_id").cast("string")).alias("source_digest"))
    custody = docs.filter("doc_id % 4 <> 3").select(F.col("source_digest").alias("digest"), F.when(F.col("doc_id") % 4 == 0, "synthesis").otherwise("original").alias("kind"), F.lit("file").alias("connector"), (F.col("doc_id") * 2).alias("first_seen"), F.lit(None).cast("string").alias("fidelity_digest"), F.array().cast("array<string>").alias("secret_flags"))
    got = store.provenance(docs, custody)
    return got.select("doc_id", "connector", F.coalesce("ingested_at", F.lit(-1)).alias("ingested_at"), F.when(F.col("source_digest").isNotNull(), F.col("text_digest")).alias("source_digest"))


@query("""SELECT 'k' || doc_id AS build_key, doc_id % 2 = 0 AND doc_id % 6 <> 0 AS hit FROM documents""")
def build_cache(spark, sf_dir):
    """Even documents are cached; every sixth entry has been damaged."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("build_key"), F.col("text").alias("payload"))
    empty = spark.createDataFrame([], "build_key string, digest string, payload string")
    cache = store.cache_put(empty, d.filter("doc_id % 2 = 0")).join(d.select("build_key", "doc_id"), "build_key")
    damaged = cache.select("build_key", "digest", F.when(F.col("doc_id") % 6 == 0, "damaged").otherwise(F.col("payload")).alias("payload"))
    return store.cache_get(damaged, d.select("build_key")).select("build_key", "hit")


@query("""SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN 2 ELSE 1 END AS missing FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def unrestorable_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_digest"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunks_digest"))
    blobs = d.filter("doc_id % 3 <> 0").select(F.col("document_digest").alias("digest")).unionByName(d.filter("doc_id % 5 <> 0").select(F.col("chunks_digest").alias("digest")))
    return store.unrestorable(d, blobs).select("doc_id", F.size("missing").alias("missing"))


@query("""WITH @CORPUS@, d AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0), f AS (SELECT 'chunks without a document' AS "check", 'error' AS lev, count(*) AS found FROM chunks WHERE doc_id % 9 = 0
UNION ALL SELECT 'documents without chunks', 'warning', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM chunks) UNION ALL SELECT 'vectors without a text', 'warning', count(*) FROM embeddings
UNION ALL SELECT 'custody that has changed', 'error', count(*) FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT 'sources in quarantine', 'warning', 0),
s AS (SELECT "check", CASE WHEN found > 0 THEN lev ELSE 'ok' END AS status, found FROM f)
SELECT * FROM s UNION ALL SELECT 'overall', ['ok', 'warning', 'error'][max(list_position(['ok', 'warning', 'error'], status))], CAST(sum(found) AS BIGINT) FROM s""")
def doctor_report(spark, sf_dir):
    docs, chunks = _corpus(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_digest"))
    custody = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 8 == 0, "sha256:-").otherwise(X.digest(F.col("text"))).alias("digest"), F.col("text").alias("content"))
    return store.doctor(docs.filter("doc_id % 9 <> 0").select("doc_id"), chunks, vectors, custody, docs.limit(0))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS kind FROM pages), o AS (SELECT page_id, kind, count(*) AS n FROM t GROUP BY 1, 2),
d AS (SELECT page_id, kind, n + CASE WHEN kind = 'p' THEN 1 ELSE 0 END AS n FROM o WHERE kind <> 'b')
SELECT coalesce(d.page_id, o.page_id) AS path, coalesce(d.kind, o.kind) AS kind, CAST(coalesce(d.n, 0) AS BIGINT) AS declared, coalesce(o.n, 0) AS observed, coalesce(d.kind, o.kind) = 'b' AS explained
FROM d FULL JOIN o ON d.page_id = o.page_id AND d.kind = o.kind WHERE coalesce(d.n, 0) <> coalesce(o.n, 0)""")
def inventory_difference(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("kind"))
    seen = lifecycle.inventory(tags)
    said = seen.filter("kind <> 'b'").withColumn("n", F.col("n") + (F.col("kind") == "p").cast("long"))
    why = spark.createDataFrame([("b", "bold is a mark, not an element")], "kind string, reason string")
    return lifecycle.inventory_difference(said, seen, why).select("path", "kind", "declared", "observed", "explained")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    folder = F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("verified")
    path = F.concat(F.lit("knowledge/"), folder, F.lit("/"), (F.col("doc_id") - F.col("doc_id") % 20).cast("string"), F.lit("/"), F.floor(F.col("doc_id") % 20 / 4).cast("string"), F.when(F.col("doc_id") % 4 < 2, "").otherwise(F.col("doc_id").cast("string")))
    return d.select("doc_id", path.alias("path"), folder.alias("status"))


@query("""WITH d AS (SELECT doc_id, 'knowledge/' || CASE WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'verified' END || '/' || (doc_id - doc_id % 20) || '/' || (doc_id % 20 // 4) || CASE WHEN doc_id % 4 < 2 THEN '' ELSE '' || doc_id END AS path, CASE WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'verified' END AS status FROM documents),
p AS (SELECT *, replace(path, '/candidate/', '/verified/') AS goal FROM d), g AS (SELECT *, status = 'candidate' AND doc_id % 3 <> 0 AND goal NOT IN (SELECT path FROM d) AS go FROM p)
SELECT doc_id, CASE WHEN go THEN goal ELSE path END AS path, CASE WHEN go THEN 'verified' ELSE status END AS status, CASE WHEN go THEN 0.95 END AS grounding FROM g""")
def promotion(spark, sf_dir):
    """Candidates whose number isn't divisible by three are grounded; those whose place among the verified is taken stay."""
    docs = _statuses(spark, sf_dir)
    scores = docs.select("path", F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.95).alias("score"), F.array().cast("array<string>").alias("blockers"))
    return lifecycle.promote(docs, scores, "reviewer", "2024-01-01").select("doc_id", "path", "status", "grounding")


# Evaluation


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grep's metrics, the lexical leg's, slices)."""
    cases, judged = _cases(spark, sf_dir)
    named = lambda hits: hits.select(F.col("query_id").alias("case_id"), "rank", "anchor")
    grep = evaluation.metrics(named(lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 10)), judged, cases)
    words = evaluation.metrics(named(lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0}, 10)), judged, cases)
    return grep, words, _slices(spark, sf_dir)


_BM = _bm25_sql(False).split("rowz AS (", 1)[1].rsplit("SELECT query_id, anchor, round(score, 6)", 1)[0].rstrip().replace(f"{ASKED}, ", "").replace("a AS (SELECT query_id, unnest(terms) AS t FROM asked), b AS", "a2 AS (SELECT query_id, unnest(terms) AS t FROM asked), b AS").replace("[1] AS term FROM a)", "[1] AS term FROM a2)")
_ARMS = f"""@EVAL@, {_SLICED.split(", ms AS")[0]}, rowz AS ({_BM}, got2 AS (SELECT query_id AS case_id, r.rank, j.grade FROM r JOIN judged j ON j.case_id = r.query_id AND j.anchor = r.anchor WHERE r.rank <= 10),
dcg2 AS (SELECT case_id, sum(CAST(round((pow(2.0, grade) - 1) / log2(rank + 1.0), 9) AS DECIMAL(20, 9))) AS dcg FROM got2 GROUP BY case_id),
m2 AS (SELECT case_id, round(coalesce(CAST(dcg AS DOUBLE) / CAST(ideal AS DOUBLE), 0), 6) AS ndcg FROM ideal LEFT JOIN dcg2 USING (case_id)),
both2 AS (SELECT case_id, m.ndcg AS g, m2.ndcg AS l FROM m JOIN m2 USING (case_id))"""
_MEAN = "round(CAST(avg(CAST(%s AS DECIMAL(18, 6))) AS DOUBLE), 6)"


@query(f"""WITH {_ARMS}, al AS (SELECT 'ALL' AS slice, g, l FROM both2 UNION ALL SELECT slice, g, l FROM both2 JOIN sl USING (case_id)),
k AS (SELECT slice, {_MEAN % 'l'} AS ours, {_MEAN % 'g'} AS theirs FROM al GROUP BY slice) SELECT slice, ours, theirs, round(ours - theirs, 6) AS lead, theirs > ours AS conceded FROM k""")
def incumbent_slices(spark, sf_dir):
    grep, words, slices = _arms(spark, sf_dir)
    return evaluation.incumbent(words, grep, slices)


@query(f"""WITH {_ARMS}, k AS (SELECT slice FROM both2 JOIN sl USING (case_id) GROUP BY slice HAVING {_MEAN % 'g'} > {_MEAN % 'l'}),
w AS (SELECT slice, case_id, l AS ours, g AS theirs, round(l - g, 6) AS gap FROM both2 JOIN sl USING (case_id) JOIN k USING (slice) WHERE g > l)
SELECT *, CAST(row_number() OVER (PARTITION BY slice ORDER BY gap, case_id) AS INTEGER) AS place FROM w""")
def incumbent_losses(spark, sf_dir):
    grep, words, slices = _arms(spark, sf_dir)
    return evaluation.losses(words, grep, slices)


@query(f"""WITH {_ARMS}, k AS (SELECT slice, {_MEAN % 'l'} AS ours, {_MEAN % 'g'} AS blessed, count(*) AS n FROM both2 JOIN sl USING (case_id) GROUP BY slice),
z AS (SELECT slice, avg(g) AS mean, list_sort(list(g) FILTER (WHERE g > 0)) AS nz FROM both2 JOIN sl USING (case_id) GROUP BY slice),
q AS (SELECT k.*, CASE WHEN blessed > 0 THEN round(ours / blessed - 1, 6) ELSE 0.0 END AS delta, n >= CASE WHEN len(nz) > 0 AND mean > 0 THEN ceil(nz[len(nz) // 2 + 1] / (0.02 * mean)) ELSE 4 END AND blessed > 0 AS armed FROM k JOIN z USING (slice))
SELECT slice, ours, blessed, delta, armed, delta < -0.02 AS moved, NOT (armed AND delta < -0.02) AS passed FROM q""")
def gate_g3_regression(spark, sf_dir):
    """The lexical leg against grep's scores as the blessed ones."""
    grep, words, slices = _arms(spark, sf_dir)
    return evaluation.gate_regression(words, grep, slices)


@query(f"""WITH {_ARMS}, o AS (SELECT CAST(avg(CAST(g AS DECIMAL(18, 6))) AS DOUBLE) AS lx, CAST(avg(CAST(l AS DECIMAL(18, 6))) AS DOUBLE) AS hy FROM both2),
sv AS (SELECT slice, CAST(avg(CAST(g AS DECIMAL(18, 6))) AS DOUBLE) AS lx, CAST(avg(CAST(l AS DECIMAL(18, 6))) AS DOUBLE) AS hy FROM both2 JOIN sl USING (case_id) GROUP BY slice),
w AS (SELECT count(*) AS n FROM sv WHERE lx > 0 AND hy / lx - 1 < -0.02)
SELECT round(lx, 6) AS lexical, round(hy, 6) AS hybrid, CASE WHEN lx > 0 THEN round(hy / lx - 1, 6) ELSE 0.0 END AS delta, CAST(n AS INTEGER) AS regressions, (CASE WHEN lx > 0 THEN round(hy / lx - 1, 6) ELSE 0.0 END) >= 0.05 AND n = 0 AS earns FROM o, w""")
def gate_g2_challenger(spark, sf_dir):
    grep, words, slices = _arms(spark, sf_dir)
    return evaluation.gate_hybrid(grep, words, slices).withColumn("regressions", F.size("regressions"))


@query(f"""WITH @CORPUS@, {ASKED}, {_GREP}, hc AS (SELECT g.query_id AS case_id, g.rank, len(regexp_extract_all(c.text, '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens, c.doc_id % 4 AS depth, c.doc_id % 11 <> 0 AS known FROM grepped g JOIN chunks c USING (anchor) WHERE g.rank <= 20),
b AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE known) AS r, count(*) FILTER (WHERE rank <= 10) AS w, count(*) FILTER (WHERE rank <= 10 AND known AND depth > 0) AS l, avg(tokens) FILTER (WHERE rank <= 10 AND known) AS t FROM hc GROUP BY 1)
SELECT item_id AS case_id, CASE WHEN n IS NULL THEN 1.0 ELSE round(r / n, 6) END AS coverage, CASE WHEN coalesce(w, 0) = 0 THEN 1.0 ELSE round(l / w, 6) END AS precision, CAST(coalesce(round_even(t, 0), 0) AS BIGINT) AS cited_tokens, n IS NULL AS abstained FROM benchmark LEFT JOIN b ON case_id = item_id""")
def citation_metrics(spark, sf_dir):
    """Chunks of every eleventh document don't resolve; a document's number says how deep its chunks lie."""
    chunks = _corpus(spark, sf_dir)[1]
    hits = lexical.grep(_asked(spark, sf_dir), chunks, 20).select(F.col("query_id").alias("case_id"), "rank", "anchor")
    known = chunks.filter("doc_id % 11 <> 0").select("anchor", "tokens", (F.col("doc_id") % 4).alias("depth"))
    return evaluation.citation_metrics(hits, known, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id")))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT 'G5 Performance' AS gate, max(CASE WHEN k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN value END) AS p50, max(CASE WHEN k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN value END) AS p95, max(CASE WHEN k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN value END) <= 150 AS passed FROM r""")
def gate_g5_latency(spark, sf_dir):
    return evaluation.gate_latency(table(spark, sf_dir, "events"), "value")


@query("SELECT 'G6 Determinism' AS gate, 0::BIGINT AS differing, true AS passed")
def gate_g6_determinism(spark, sf_dir):
    """Two builds of the same tables, dealt to other partitions, agree in every digest."""
    docs, chunks = _corpus(spark, sf_dir)
    one = lifecycle.observe({"documents": docs, "chunks": chunks})
    return evaluation.gate_determinism(one, lifecycle.observe({"documents": docs.repartition(7), "chunks": chunks.repartition(5)}))


@query(f"""WITH @EVAL@, ok AS (SELECT anchor, len(regexp_extract_all(text, '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens FROM chunks WHERE doc_id % 5 <> 0),
un AS (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT case_id FROM judged))
SELECT case_id, 'error' AS level, 'no such chunk' AS problem, anchor FROM judged WHERE anchor NOT IN (SELECT anchor FROM ok)
UNION ALL SELECT case_id, 'warning', 'a heading without an answer', anchor FROM judged JOIN ok USING (anchor) WHERE grade = 3 AND tokens < 30
UNION ALL SELECT query_id, 'error', 'unanswerable but answered', anchor FROM grepped WHERE rank = 1 AND query_id IN (SELECT item_id FROM un)""")
def judged_set_problems(spark, sf_dir):
    """The judged set against a corpus that has lost every fifth document."""
    cases, judged = _cases(spark, sf_dir)
    chunks = _corpus(spark, sf_dir)[1]
    first = lexical.grep(_asked(spark, sf_dir), chunks, 1).select(F.col("query_id").alias("case_id"), "anchor")
    return evaluation.validate(cases, judged, chunks.filter("doc_id % 5 <> 0").select("anchor", "tokens"), first)


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), i AS (SELECT DISTINCT CAST(floor(i * n / 100) AS BIGINT) AS k FROM r, range(100) t(i) WHERE r.k = 0) SELECT o_orderkey FROM r JOIN i USING (k)")
def even_sample(spark, sf_dir):
    return evaluation.evenly(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


# Re-rankers over grep's first fifty

_POOL = f"""@CORPUS@, {ASKED}, {_GREP}, k AS (SELECT g.query_id, g.anchor, g.distinct_terms, g.occurrences, g.rank, g.distinct_terms::DOUBLE AS score, regexp_extract(g.anchor, '^(.*/)[^/]*$', 1) AS section, 1 + c.ordinal % 4 AS depth, c.ordinal, len(regexp_extract_all(c.text, '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens, c.text
  FROM grepped g JOIN chunks c USING (anchor) WHERE g.rank <= 50)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _corpus(spark, sf_dir)[1]
    hits = written(lexical.grep(_asked(spark, sf_dir), chunks, 50), "hits")  # so that its size is known and no text moves to meet it
    hits = hits.join(chunks.select("anchor", "ordinal", "tokens", "text", "chunk_digest"), "anchor")
    return hits.withColumn("score", F.col("distinct_terms").cast("double")).withColumn("section", X.section_of(F.col("anchor"))).withColumn("doc", X.section_of(F.col("anchor"))).withColumn("depth", 1 + F.col("ordinal") % 4)


_TEN = "SELECT query_id, anchor, CAST(n AS INTEGER) AS rank FROM z WHERE n <= 10"


@query(f"WITH {_POOL}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * pow(1.2::DOUBLE, greatest(depth - 1, 0)), 6) DESC, rank) AS n FROM k) {_TEN}")
def rerank_depth_boost(spark, sf_dir):
    return retrieval.depth_boost(_pool(spark, sf_dir), 1.2).select("query_id", "anchor", "rank")


@query(f"WITH {_POOL}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distinct_terms DESC, score DESC, anchor) AS n FROM k) {_TEN}")
def rerank_coverage_first(spark, sf_dir):
    return retrieval.coverage_first(_pool(spark, sf_dir)).select("query_id", "anchor", "rank")


@query(f"WITH {_POOL}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * least(1.0, tokens / 30.0::DOUBLE), 6) DESC, anchor) AS n FROM k) {_TEN}")
def rerank_length_prior(spark, sf_dir):
    return retrieval.length_prior(_pool(spark, sf_dir), 30).select("query_id", "anchor", "rank")


@query(f"WITH {_POOL}, y AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, anchor) AS b FROM k), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS n FROM y WHERE b = 1) {_TEN}")
def rerank_section_best(spark, sf_dir):
    return retrieval.section_best(_pool(spark, sf_dir)).select("query_id", "anchor", "rank")


@query(f"""WITH {_POOL}, f AS (SELECT query_id, section, min(rank) AS first FROM k GROUP BY 1, 2), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC) AS srank FROM f WHERE first % 3 <> 0),
y AS (SELECT k.*, srank, max(score) OVER (PARTITION BY k.query_id, k.section) AS best FROM k LEFT JOIN sr ON sr.query_id = k.query_id AND sr.section = k.section), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY srank NULLS LAST, best DESC, section, score DESC, anchor) AS n FROM y) {_TEN}""")
def rerank_section_order(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return retrieval.section_order(pool, _sections(pool)).select("query_id", "anchor", "rank")


def _sections(pool: DataFrame) -> DataFrame:
    """A ranking of sections that isn't the chunks' own: the last first, without every third."""
    first = pool.groupBy("query_id", "section").agg(F.min("rank").alias("first")).filter("first % 3 <> 0")
    return first.select("query_id", "section", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("first"))).alias("rank"))


@query(f"""WITH {_POOL}, f AS (SELECT query_id, section, min(rank) AS first FROM k GROUP BY 1, 2), y AS (SELECT k.*, row_number() OVER (PARTITION BY query_id, section ORDER BY rank) AS b FROM k),
o AS (SELECT y.query_id, y.rank, CASE WHEN q.anchor IS NOT NULL THEN q.anchor ELSE y.anchor END AS anchor FROM y LEFT JOIN k q ON q.query_id = y.query_id AND q.anchor = y.section || '0' WHERE b = 1), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM o) {_TEN}""")
def rerank_open_if_candidate(spark, sf_dir):
    return retrieval.open_if_candidate(_pool(spark, sf_dir)).select("query_id", "anchor", "rank")


@query(f"""WITH {_POOL}, t AS (SELECT query_id, rank, sha256(text) AS digest, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS ts, section, ordinal FROM k WHERE rank <= 10),
d AS (SELECT query_id, sum(n - 1) AS dup FROM (SELECT query_id, digest, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT a.query_id, count(*) AS ov FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank AND a.digest <> b.digest WHERE len(list_distinct(list_concat(a.ts, b.ts))) > 0 AND len(list_intersect(a.ts, b.ts)) >= 0.8 * len(list_distinct(list_concat(a.ts, b.ts))) GROUP BY 1),
j AS (SELECT query_id, count(*) FILTER (WHERE st = 1) AS ad FROM (SELECT query_id, ordinal - lag(ordinal) OVER (PARTITION BY query_id, section ORDER BY ordinal) AS st FROM t) GROUP BY 1), q AS (SELECT DISTINCT query_id FROM t)
SELECT count(*) AS cases, CAST(coalesce(sum(dup), 0) AS BIGINT) AS duplicate_slots, CAST(coalesce(sum(ov), 0) AS BIGINT) AS overlapping_pairs, CAST(coalesce(sum(ad), 0) AS BIGINT) AS adjacent_slots, count(*) FILTER (WHERE dup > 0) AS with_duplicate, count(*) FILTER (WHERE ov > 0) AS with_overlap, count(*) FILTER (WHERE ad > 0) AS with_adjacent
FROM q LEFT JOIN d USING (query_id) LEFT JOIN o USING (query_id) LEFT JOIN j USING (query_id)""")
def redundancy_report(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(f"({X.TERM})"), 1)
    pool = _pool(spark, sf_dir).select("query_id", "anchor", "rank", F.col("chunk_digest").alias("digest"), tokens.alias("tokens"), "section", F.col("ordinal").alias("position"))
    return retrieval.redundancy(pool)


# Chats


@query("""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS ts, list(role ORDER BY turn) AS rs FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(range(1, len(ts) + 1)) AS k, ts, rs FROM t), u AS (SELECT conv_id, k, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN lower(rs[k]) = 'assistant' THEN 'assistant' ELSE 'user' END ELSE 'fragment' END AS role, replace(ts[k], chr(10), ' ') AS text FROM l)
SELECT conv_id AS doc, CAST(count(*) AS BIGINT) AS turns, count(*) FILTER (WHERE role = 'assistant') AS assistant FROM u WHERE conv_id % 2 = 0 GROUP BY 1 UNION ALL SELECT conv_id, 1, 0 FROM t WHERE conv_id % 2 = 1""")
def pasted_chats(spark, sf_dir):
    """Even conversations are pasted with labels, odd ones without: those stay whole."""
    label = F.when(F.lower("role") == "assistant", "ChatGPT said: ").otherwise("You: ")
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.when(F.col("conv_id") % 2 == 0, F.concat(label, flat)).otherwise(F.concat(F.lit("- "), flat)).alias("line"))
    return chats.pasted(lines).groupBy("doc").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("assistant"))


@query("SELECT conv_id AS doc, ['callout', 'heading', 'bold'][conv_id % 3 + 1] AS convention, count(*) AS markers FROM conversations GROUP BY conv_id")
def transcript_conventions(spark, sf_dir):
    word = F.when(F.lower("role") == "assistant", "Assistant").otherwise("User")
    mark = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("> [!"), word, F.lit("]"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("## 3 · "), word)).otherwise(F.concat(F.lit("**"), word, F.lit("**:")))
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), mark.alias("line"))
    return chats.convention(lines)


@query("""SELECT conv_id, ['chatgpt', 'claude', 'pasted'][conv_id % 3 + 1] AS reader FROM (SELECT DISTINCT conv_id FROM conversations)""")
def reader_dispatch(spark, sf_dir):
    text = F.element_at(F.array(F.lit('[{"mapping": {}, "current_node": "a"}]'), F.lit('[{"chat_messages": []}]'), F.lit("no labels here\nand none here")), (F.col("conv_id") % 3 + 1).cast("int"))
    return chats.reader(table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("text", text)).select("conv_id", "reader")


@query("""WITH a AS (SELECT DISTINCT upper(sha256('' || conv_id)) AS conv_id FROM conversations), q AS (SELECT conv_id AS asked FROM a UNION SELECT substr(conv_id, 1, 8) FROM a UNION SELECT substr(conv_id, 1, 1) FROM a UNION SELECT 'nothing'),
m AS (SELECT asked, count(DISTINCT conv_id) AS n, min(conv_id) AS c FROM q LEFT JOIN a ON conv_id = upper(asked) OR starts_with(conv_id, upper(asked)) OR ends_with(conv_id, upper(asked)) GROUP BY asked)
SELECT asked, CASE WHEN n = 1 THEN c END AS conv_id, CASE WHEN n = 0 THEN 'no such conversation' WHEN n > 1 THEN 'more than one conversation' END AS error FROM m""")
def archive_find(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select(F.upper(F.sha2(F.col("conv_id").cast("string"), 256)).alias("conv_id")).distinct()
    asked = a.select(F.col("conv_id").alias("asked"))
    for n in (8, 1):
        asked = asked.unionByName(a.select(F.substring("conv_id", 1, n).alias("asked")))
    return chats.find(a, asked.unionByName(spark.createDataFrame([("nothing",)], "asked string")).distinct())


@query("""WITH c AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, CAST(row_number() OVER (ORDER BY CASE WHEN conv_id % 2 = 0 THEN 1000 + conv_id % 7 ELSE conv_id % 5 END DESC, conv_id DESC) AS INTEGER) AS place FROM c""")
def archive_list(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rows = a.select("conv_id", F.when(F.col("conv_id") % 2 == 0, 1000 + F.col("conv_id") % 7).alias("started_at"), (F.col("conv_id") % 5).alias("imported_at"))
    return chats.listed(rows).select("conv_id", "place")


@query("""SELECT conv_id AS doc, CASE conv_id % 5 WHEN 1 THEN 'lines before the first turn' WHEN 2 THEN 'lines do not rise' WHEN 3 THEN 'a line beyond the text' WHEN 4 THEN 'an unknown role' END AS problem FROM (SELECT DISTINCT conv_id FROM conversations)""")
def segmentation_check(spark, sf_dir):
    k = F.col("conv_id") % 5
    turn = lambda line, who: F.struct(line.cast("int").alias("line"), who.alias("role"))
    turns = F.array(turn(F.when(k == 1, 2).otherwise(0), F.lit("user")), turn(F.when(k == 2, 0).when(k == 3, 99).otherwise(3), F.when(k == 4, "nobody").otherwise("assistant")))
    return chats.checked_boundaries(table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("doc"), turns.alias("turns"), F.lit(9).alias("lines")))


# Scalar functions


@query("""WITH n AS (SELECT doc_id, nfc_normalize(regexp_replace(text, '^﻿', '')) AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\\t\\v\\f \u0085   -     　\x1c-\x1f]+(\n|$)', '\\1', 'g'), '\n+$', '')) AS digest FROM n""")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalized(F.col("text")), 256).alias("digest"))


@query("""SELECT page_id, 'knowledge/evidence/' || coalesce(nullif(regexp_replace(regexp_replace(lower(trim(list_last(string_split(regexp_replace(url, '/+$', ''), '/')))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'source') || '-' || substr(sha256(html), 1, 8) || '.md' AS evidence,
  'knowledge/candidate/' || coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'candidate') || '.md' AS candidate FROM pages""")
def derived_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.evidence_path(F.col("url"), X.digest(F.col("html"))).alias("evidence"), X.candidate_path(F.col("url")).alias("candidate"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS text, true AS same FROM events")
def utc_texts(spark, sf_dir):
    """Instants as RFC 3339 and back."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = e.withColumn("text", X.rfc3339(F.col("ts")))
    return text.select("event_id", "text", (X.instant(F.col("text")) == F.col("ts")).alias("same"))


@query("""SELECT o_orderpriority AS grp, ['unknown', 'low', 'medium', 'high'][CAST(min(o_orderkey % 3 + 2) AS BIGINT)] AS weakest FROM orders GROUP BY 1""")
def weakest_source_trust(spark, sf_dir):
    trust = F.element_at(F.array(*map(F.lit, X.TRUST)), (F.col("o_orderkey") % 3 + 2).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.collect_set(trust).alias("t")).select("grp", X.weakest_trust(F.col("t")).alias("weakest"))


@query("""SELECT s_suppkey, CASE WHEN contains(s_name, '00000001') THEN 'high' WHEN contains(s_name, '0000') THEN 'low' ELSE 'unknown' END AS trust FROM supplier""")
def trust_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("uri"))
    return citations.trust_of(s, [("0000", "low"), ("00000001", "high")], "unknown").select("s_suppkey", "trust")


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS task_id, o_orderkey AS anchor, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, CAST(floor(o_totalprice % 300) AS BIGINT) AS tokens FROM orders),
p AS (SELECT task_id, 0 AS rank, 0::BIGINT AS spent, []::BIGINT[] AS kept, false AS over FROM s GROUP BY 1 UNION ALL
SELECT p.task_id, s.rank, CASE WHEN p.spent + s.tokens <= 250 THEN p.spent + s.tokens ELSE p.spent END, CASE WHEN p.spent + s.tokens <= 250 THEN list_append(p.kept, s.anchor::BIGINT) ELSE p.kept END, p.over OR (s.rank = 1 AND s.tokens > 250) FROM p JOIN s ON s.task_id = p.task_id AND s.rank = p.rank + 1),
l AS (SELECT task_id, arg_max(spent, rank) AS spent, arg_max(kept, rank) AS kept, bool_or(over) AS over FROM p GROUP BY 1), r AS (SELECT task_id, max(anchor) AS need FROM s GROUP BY 1)
SELECT task_id, NOT over AND list_contains(kept, need::BIGINT) AS found, CAST(CASE WHEN over THEN 0 ELSE spent END AS BIGINT) AS tokens FROM l JOIN r USING (task_id)""")
def task_context_cost(spark, sf_dir):
    """A customer is a task, whose orders are its hits; it requires the last."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("task_id"), rank.alias("rank"), F.col("o_orderkey").cast("string").alias("anchor"), F.floor(F.col("o_totalprice") % 300).cast("long").alias("tokens"))
    need = o.groupBy(F.col("o_custkey").alias("task_id")).agg(F.max("o_orderkey").cast("string").alias("anchor"))
    return citations.context_cost(hits, need, 250)


@query("""WITH @CORPUS@, u AS (SELECT doc_id, anchor, sha256(text) AS h, doc_id % 3 AS k FROM chunks WHERE ordinal = 0)
SELECT 'doc:' || anchor || '?lines=1-2&digest=' || substr(h, 1, 12) AS uri, 'ok' AS status, CASE k WHEN 0 THEN 'current' WHEN 1 THEN 'moved' ELSE 'rewritten' END AS drift FROM u""")
def fetch_drift(spark, sf_dir):
    """First chunks are cited; of every third document they have moved since, of every third they are rewritten."""
    c = _corpus(spark, sf_dir)[1].filter("ordinal = 0")
    cited = c.select(citations.uri(F.col("anchor"), F.lit(1), F.lit(2), F.col("chunk_digest")).alias("uri"))
    k = F.col("doc_id") % 3
    now = c.select("anchor", "text", F.when(k == 2, "sha256:-").otherwise(F.col("chunk_digest")).alias("chunk_digest"), F.when(k == 1, 5).otherwise(1).alias("first"), F.when(k == 1, 6).otherwise(2).alias("last"))
    return citations.fetch_cited(cited, now).select("uri", "status", "drift")


@query(f"""WITH lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT doc_id AS path, round(least(c, coalesce(e, 0)), 6) AS score, len(list_filter([c < 0.95, e IS NULL, e < 0.9], lambda x: x)) AS blockers
FROM (SELECT d.doc_id, (d.doc_id % 10) / 10.0::DOUBLE + 0.1 AS c, CASE WHEN quality = 1 THEN 0.97 WHEN quality = 0 THEN 0.5 END AS e FROM documents d LEFT JOIN lab USING (doc_id))""")
def grounding_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), ((F.col("doc_id") % 10) / F.lit(10.0) + 0.1).alias("coverage"))
    judged = _labelled(spark, sf_dir).select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, 0.97).when(F.col("quality") == 0, 0.5).alias("entailment")).filter("entailment is not null")
    return citations.grounding(d, judged).select("path", F.round("score", 6).alias("score"), F.size("blockers").cast("long").alias("blockers"))


# Compiled Markdown: each supplier is a document whose sections are known


def _notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("---\ntitle: "), F.col("s_name"), F.lit("\ntags: [t"), (F.col("s_suppkey") % 5).cast("string"), F.lit(", x]\nrating: "), key, F.lit("\n---\n# "), F.col("s_name"), F.lit("\n\nIntro of "), key, F.lit(" with [[Other|shown]] and `[[not]]`.\n\n## Notes\n\nFirst #tag"),
        key, F.lit(" here, see [next](../s"), key, F.lit(".md#Top).\n\n## Notes\n\n- one\n- two\n\n```python\ndef f_"), key, F.lit("(x):\n    return g_"), (F.col("s_suppkey") % 7).cast("string"), F.lit("(x)\n```\n\n### Deep\n\n`uv run` it.\n\n```bash\nuv run job"), key, F.lit("\n```\n"),
    )
    return s.select("s_suppkey", F.concat(F.lit("s"), key, F.lit(".md")).alias("path"), text.alias("text"))


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.md#' AS p FROM supplier)
SELECT p || '/0' AS anchor, 'text' AS kind, 1::BIGINT AS depth FROM s UNION ALL SELECT p || 'notes/0', 'text', 2 FROM s UNION ALL SELECT p || 'notes-2/0', 'text', 2 FROM s UNION ALL SELECT p || 'notes-2/deep/0', 'text', 3 FROM s""")
def markdown_sections(spark, sf_dir):
    got = markdown.chunks(_notes_text(spark, sf_dir))
    return got.select("anchor", "kind", F.size("heading_path").cast("long").alias("depth"))


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.md' AS path FROM supplier)
SELECT path, 'wikilink' AS kind, 'Other' AS target FROM s UNION ALL SELECT path, 'link', '../s' || k || '.md#Top' FROM s UNION ALL SELECT path, 'tag_ref', 'tag' || k FROM s""")
def markdown_references(spark, sf_dir):
    return markdown.links(markdown.nodes(_notes_text(spark, sf_dir))).select("path", "kind", "target")


@query("""SELECT 's' || s_suppkey || '.md' AS path, kind, n FROM supplier, (VALUES ('heading', 4::BIGINT), ('paragraph', 5), ('list', 1), ('list_item', 2), ('code_block', 2)) t(kind, n)""")
def markdown_node_kinds(spark, sf_dir):
    return lifecycle.inventory(markdown.nodes(_notes_text(spark, sf_dir)))


@query("""SELECT 's' || s_suppkey || '.md' AS path, s_name AS title, 't' || (s_suppkey % 5) || ',x' AS tags, '{"rating": ' || s_suppkey || '}' AS properties FROM supplier""")
def frontmatter_columns(spark, sf_dir):
    got = frontmatter.frontmatter(_notes_text(spark, sf_dir).select("path", "text"))
    return got.select("path", "title", F.array_join("tags", ",").alias("tags"), "properties")


@query("""SELECT 's' || s_suppkey || '.md' AS path, sha256('---' || chr(10) || 'title: new' || chr(10) || 'k: ' || s_suppkey || chr(10) || '---' || chr(10) || 'body') AS digest FROM supplier""")
def frontmatter_upsert(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    d = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key, F.lit(".md")).alias("path"), F.concat(F.lit("---\ntitle: old\nk: "), key, F.lit("\n---\nbody")).alias("text"), F.lit("new").alias("v"))
    return frontmatter.stamped(d, "title", "v").select("path", F.sha2("text", 256).alias("digest"))


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.md' AS path FROM supplier)
SELECT path, 'python' AS lang, 'f_' || k AS name, 'define' AS role FROM s UNION ALL SELECT path, 'python', 'g_' || (k % 7), 'use' FROM s UNION ALL SELECT path, 'cli', 'uv', 'define' FROM s UNION ALL SELECT path, 'cli', 'uv run', 'define' FROM s
UNION ALL SELECT path, 'cli', 'uv run job' || k, 'define' FROM s UNION ALL SELECT path, 'cli', 'uv', 'use' FROM s UNION ALL SELECT path, 'cli', 'uv run', 'use' FROM s""")
def symbol_extraction(spark, sf_dir):
    return symbols.extract(markdown.nodes(_notes_text(spark, sf_dir))).select("path", "lang", "name", "role")


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.md' AS path FROM supplier)
SELECT 'sym:python:f_' || k AS symbol, 'function' AS kind, path || '#L20' AS defined_in FROM s UNION ALL SELECT 'sym:cli:uv', 'command', min(path) || '#L29' FROM s UNION ALL SELECT 'sym:cli:uv run', 'command', min(path) || '#L29' FROM s""")
def symbol_table(spark, sf_dir):
    """Commands are symbols only where prose names them too; a job's name never is."""
    return symbols.fold(symbols.extract(markdown.nodes(_notes_text(spark, sf_dir)))).select("symbol", "kind", "defined_in")


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS code FROM pages), c AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(code, '"[^"]*"', '""', 'g'), '([A-Za-z_$][A-Za-z_0-9$]*)\(', 1)) AS name FROM s)
SELECT DISTINCT page_id, 'javascript' AS lang, name, 'use' AS role FROM c""")
def page_script_calls(spark, sf_dir):
    """What the scripts of whole pages define and call."""
    codes = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)
    nodes = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.posexplode(codes).alias("first", "text")).withColumn("kind", F.lit("code_block")).withColumn("lang", F.lit("js"))
    return symbols.extract(nodes).select(F.col("path").cast("long").alias("page_id"), "lang", "name", "role").distinct()


@query("""SELECT 'doc:a' || p_partkey || '.md' AS source, 'sym:python:lib.f_' || (p_partkey % 9) AS target FROM part WHERE p_partkey % 9 <> 4""")
def symbol_uses(spark, sf_dir):
    """Uses by last part; f_4 is defined twice, so its uses are ambiguous."""
    uses = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("f_"), (F.col("p_partkey") % 9).cast("string")).alias("name"), F.lit(3).alias("line"))
    defined = spark.range(9).select(F.lit("lib.md").alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("lib.f_"), F.col("id").cast("string")).alias("name"))
    defined = defined.unionByName(defined.filter("name = 'lib.f_4'").withColumn("name", F.lit("other.f_4")))
    got = symbols.resolve(uses, defined)
    return got.select(graph.doc_ref(F.col("path")).alias("source"), symbols.symbol_id(F.col("lang"), F.col("symbol")).alias("target"))


@query("""WITH d AS (SELECT 'd' || lpad(s_suppkey::VARCHAR, 9, '0') AS path, 'Tag ' || (s_suppkey % 6) AS tag, s_suppkey % 2 = 0 AS hand FROM supplier)
SELECT 'tag-' || right(tag, 1) AS slug, tag AS name, 'tag' AS kind, CASE WHEN bool_or(hand) THEN 'authored' ELSE 'extracted' END AS status, count(DISTINCT path) AS docs FROM d GROUP BY tag""")
def entity_table(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    d = s.select(F.concat(F.lit("d"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("path"), F.lit("T").alias("title"), F.array(F.concat(F.lit("#Tag "), (F.col("s_suppkey") % 6).cast("string")), F.lit("2024")).alias("tags"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("s_suppkey") % 2 == 0, "authored").otherwise("ingested").alias("origin"))
    return symbols.fold_entities(symbols.declare_entities(d)).select("slug", "name", "kind", "status", F.size("doc_refs").cast("long").alias("docs"))


# Sources


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'bom' WHEN regexp_matches(html[:4096], '(?i)<meta[^>]+charset=["'']?utf-?8') THEN 'declared' ELSE 'utf-8' END AS rule, sha256(html) AS digest FROM pages""")
def decoded_pages(spark, sf_dir):
    """Every page as bytes, every third with a byte order mark, read as text again: by the mark, the declared charset, or as UTF-8."""
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", html.decoded(raw).alias("d")).select("page_id", "d.rule", F.sha2("d.text", 256).alias("digest"))


_EXT = ("md", "html", "pdf", "docx", "txt", "rst")


@query(f"""WITH f AS (SELECT s_suppkey, 'd/f' || s_suppkey || '.' || {list(_EXT)!r}[s_suppkey % 6 + 1] AS path, s_suppkey % 4 = 0 AS pdf FROM supplier)
SELECT path, CASE regexp_extract(path, '[^.]+$') WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'rst' THEN 'text/x-rst' END AS media,
  pdf AND regexp_extract(path, '[^.]+$') NOT IN ('pdf', 'txt') AS warned FROM f""")
def media_types(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("d/f"), F.col("s_suppkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("s_suppkey") % 6 + 1).cast("int")))
    rows = s.select(path.alias("path"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"words")).alias("content"))
    return rows.select("path", html.media_type(F.col("path")).alias("media"), html.mismatch(F.col("path"), F.col("content")).isNotNull().alias("warned"))


@query("""WITH p AS (SELECT 'n' || (o_orderkey % 5) || '/' || CASE WHEN o_orderkey % 7 = 0 THEN 'drafts/' ELSE '' END || 'x' || o_orderkey || '.md' AS path FROM orders)
SELECT path, starts_with(path, 'n3/') OR contains(path, '/drafts/') OR regexp_matches(path, '/x[0-9]1\\.md$') AS excluded FROM p""")
def excluded_paths(spark, sf_dir):
    key = F.col("o_orderkey")
    path = F.concat(F.lit("n"), (key % 5).cast("string"), F.lit("/"), F.when(key % 7 == 0, "drafts/").otherwise(""), F.lit("x"), key.cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "orders").select(path.alias("path")).withColumn("excluded", X.excluded(F.col("path"), ["n3", "**/drafts", "x?1.md"]))


@query("""SELECT page_id, sha256('a' || page_id || ' <lone> bold  end') AS digest FROM pages""")
def stripped_markup(spark, sf_dir):
    text = F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit(" <lone> <b>bold</b> <!-- gone --> <img src='x'>end</p>"))
    return table(spark, sf_dir, "pages").select("page_id", markup.stripped(text).alias("t")).select("page_id", F.sha2("t", 256).alias("digest"))


@query("SELECT item_id AS case_id, text AS query FROM benchmark")
def case_round_trip(spark, sf_dir):
    """Cases as JSON lines, read again."""
    at = f"{work.folder(spark)}/cases-{uuid.uuid4().hex}"
    cases = table(spark, sf_dir, "benchmark").select(F.format_string("%09d", "item_id").alias("case_id"), F.col("text").alias("query"))
    files.write_cases(cases, at)
    return files.read_cases(spark, at, "case_id string, query string").select(F.col("case_id").cast("long").alias("case_id"), "query")


@query("SELECT 1 AS version, count(*) AS documents, 'publish' AS action FROM documents UNION ALL SELECT 2, count(*) FILTER (WHERE doc_id % 2 = 0), 'publish' FROM documents UNION ALL SELECT 3, count(*), 'rollback' FROM documents")
def snapshot_history(spark, sf_dir):
    """Two snapshots and a rollback, as the journal and the current tables tell it."""
    s = snapshots.Snapshots(spark, f"{work.folder(spark)}/snapshots-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    first = s.publish({"documents": docs})
    s.publish({"documents": docs.filter("doc_id % 2 = 0")})
    s.rollback(first)
    out = None
    for n, line in enumerate(s.journal(), 1):
        one = s.read("documents", line["snapshot"]).agg(F.lit(n).alias("version"), F.count("*").alias("documents"), F.lit(line["action"]).alias("action"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR (doc_id % 7 = 0 AND text <> upper(text))""")
def snapshot_changes(spark, sf_dir):
    """What differs between two versions, by their digest trees: some documents are edited, some removed, some added."""
    s = snapshots.Snapshots(spark, f"{work.folder(spark)}/snapshots-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    first = s.publish({"documents": docs.filter("doc_id % 13 <> 0 or doc_id % 11 = 0")}, keys={"documents": ["doc_id"]})
    edited = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    return s.changes("documents", first, s.publish({"documents": edited}, keys={"documents": ["doc_id"]}))


# Chats, judgements and the bound of a query


@query("""WITH h AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT c.conv_id, c.turn::VARCHAR AS node, CASE WHEN c.conv_id % 2 = 0 OR c.turn <= last - 1 THEN 'message' ELSE 'abandoned_branch' END AS kind FROM conversations c JOIN h USING (conv_id)""")
def conversation_branches(spark, sf_dir):
    """Turns as a tree, each under the one before; of odd conversations the head is the last but one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    nodes = c.select("conv_id", F.col("turn").cast("string").alias("node"), before.cast("string").alias("parent"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    head = c.join(last, "conv_id").filter(F.when(F.col("conv_id") % 2 == 0, F.col("turn") == F.col("last")).otherwise(F.col("turn") <= F.col("last") - 1))
    return chats.branch(nodes, head.groupBy("conv_id").agg(F.max("turn").cast("string").alias("node")))


@query(f"WITH {_MSG} SELECT conv_id, string_agg('{{\"role\":\"' || role || '\",\"seq\":' || seq || ',\"text\":' || to_json(text)::VARCHAR || '}}', chr(10) ORDER BY seq) AS payload FROM msg GROUP BY conv_id")
def chat_jsonl_export(spark, sf_dir):
    return chats.export(_messages(spark, sf_dir), "jsonl")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ts FROM documents) SELECT doc_id, greatest(len(ts) - 64, 0) AS unread, len(list_slice(ts, 1, 64)) AS terms, list_extract(list_slice(ts, 1, 64), -1) AS last FROM t""")
def bounded_queries(spark, sf_dir):
    """Whole documents as questions: what is read of them."""
    d = table(spark, sf_dir, "documents")
    seen = F.regexp_extract_all(X.bounded(F.col("text")), F.lit(f"({X.TERM})"), 1)
    return d.select("doc_id", X.unread_terms(F.col("text")).cast("long").alias("unread"), seen.alias("ts")).select("doc_id", "unread", F.size("ts").cast("long").alias("terms"), F.try_element_at("ts", F.lit(-1)).alias("last"))


@query("""WITH c AS (SELECT item_id AS path, item_id % 2 = 0 AS cites, item_id % 3 = 0 AS known FROM benchmark)
SELECT path, 2::BIGINT AS claims, CAST(CASE WHEN cites AND known THEN 1 ELSE 0 END AS BIGINT) AS cited, CAST(CASE WHEN cites AND NOT known THEN 1 ELSE 0 END AS BIGINT) AS dangling, CASE WHEN cites AND known THEN 0.5 ELSE 0.0 END AS coverage, false AS holds FROM c""")
def citation_contract(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"))
    name = F.concat(F.lit("n"), F.col("path").cast("string"))
    first = F.concat(F.lit("one claim of five words "), F.when(F.col("path") % 2 == 0, F.concat(F.lit("[["), name, F.lit("#part|shown]]"))).otherwise(""))
    claims = b.select("path", F.lit(1).alias("ord"), first.alias("text")).unionByName(b.select("path", F.lit(2).alias("ord"), F.lit("another claim of five words").alias("text"))).unionByName(b.select("path", F.lit(3).alias("ord"), F.lit("too short").alias("text")))
    return citations.contract(claims, b.filter("path % 3 = 0").select(name.alias("name")), sections_only=b.select(name.alias("name")))


@query(f"""WITH {_ARMS}, p AS (SELECT case_id, round(CAST(ideal AS DOUBLE) / CAST(ideal AS DOUBLE), 6) AS perfect FROM ideal) SELECT case_id, greatest(g, l) AS best, perfect FROM both2 JOIN p USING (case_id)""")
def oracle_ceilings(spark, sf_dir):
    """The best arm of each case, and the perfect order's score."""
    grep, words, _ = _arms(spark, sf_dir)
    arms = grep.select("case_id", F.lit("grep").alias("arm"), "ndcg").unionByName(words.select("case_id", F.lit("lexical").alias("arm"), "ndcg"))
    return retrieval.oracle_ceiling(arms, grep.select("case_id", F.lit(1.0).alias("perfect")))


@query("""WITH s AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, CAST(floor(o_totalprice % 50) AS BIGINT) AS tokens FROM orders), t AS (SELECT doc, sum(tokens) AS total, count(*) AS n FROM s GROUP BY doc),
c AS (SELECT s.doc, s.ord, sum(s2.tokens) AS run FROM s JOIN s s2 ON s.doc = s2.doc AND s2.ord <= s.ord GROUP BY 1, 2)
SELECT t.doc AS task_id, CASE WHEN total <= 90 THEN n - 1 ELSE greatest(coalesce((SELECT max(ord) FROM c WHERE c.doc = t.doc AND run <= 90), 0), 0) END AS last FROM t""")
def window_reads(spark, sf_dir):
    """A customer is a document whose orders are its sections; the first is the hit, so a window grows downwards only."""
    o = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    sections = o.select(F.col("o_custkey").alias("doc"), place.alias("ord"), F.floor(F.col("o_totalprice") % 50).cast("long").alias("tokens"))
    hits = sections.filter("ord = 0").select(F.col("doc").alias("task_id"), "doc", "ord")
    return citations.window_reads(sections, hits, 90).select("task_id", F.col("last").cast("long").alias("last"))


# What is left of the inventory


@query("""WITH @CORPUS@, b AS (SELECT doc_id, string_agg(list_aggregate(list_filter(string_split_regex(trim(text, chr(32) || chr(9)), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> ''), 'string_agg', ' '), ' ' ORDER BY ordinal) AS body FROM chunks GROUP BY 1),
e AS (SELECT 'content' AS name, sha256(path) AS o, sha256(coalesce(body, '')) AS c FROM docs LEFT JOIN b USING (doc_id) UNION ALL SELECT 'chunks', sha256(anchor), sha256('sha256:' || sha256(text)) FROM chunks),
f AS (SELECT name, substr(o, 1, 1) AS b, sha256(string_agg(o || c, chr(10) ORDER BY o, c)) AS d FROM e GROUP BY 1, 2) SELECT name, sha256(string_agg(b || d, chr(10) ORDER BY b)) AS digest FROM f GROUP BY name""")
def corpus_fingerprints(spark, sf_dir):
    docs, chunks = _corpus(spark, sf_dir)
    return lifecycle.fingerprints(docs, chunks)


@query("""WITH m AS (SELECT l_orderkey AS archive, CASE WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN '../x' ELSE 'a/' || l_linenumber END AS name, l_linenumber AS packed, CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber * 300 ELSE l_linenumber * 2 END AS unpacked FROM lineitem),
b AS (SELECT archive, count(*) AS n, sum(unpacked) AS u, sum(packed) AS p, bool_or(name = '../x') AS esc FROM m GROUP BY 1)
SELECT archive, CASE WHEN n > 6 THEN 'too many members' WHEN u > 8000 THEN 'too large' WHEN u > 200 * greatest(p, 1) THEN 'ratio' WHEN esc THEN 'path escapes' END AS refused FROM b""")
def archive_guards(spark, sf_dir):
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    members = table(spark, sf_dir, "lineitem").select(order.alias("archive"), F.when((line == 3) & (order % 5 == 0), "../x").otherwise(F.concat(F.lit("a/"), line.cast("string"))).alias("name"), line.cast("long").alias("packed"), F.when(order % 7 == 0, line * 300).otherwise(line * 2).cast("long").alias("unpacked"))
    return lifecycle.archive_guard(members, most=6, size=8000)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, contains(line, 'e') AS cited FROM l WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 5)
SELECT doc_id, count(*) AS claims, count(*) FILTER (WHERE cited) AS cited, round(count(*) FILTER (WHERE cited) / count(*), 6) AS coverage FROM c GROUP BY doc_id""")
def claim_coverage(spark, sf_dir):
    """Lines of five words are claims; those with an e count as cited."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return evaluation.coverage(lines.withColumn("cited", F.col("text").contains("e")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey AS task_id, max(CASE WHEN k = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN v END) AS p95, median(v)::DOUBLE AS middle FROM r GROUP BY 1""")
def task_percentiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task_id"))
    return o.agg(evaluation.p95_floor(F.collect_list("o_orderkey")).alias("p95"), F.median("o_orderkey").alias("middle"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE vec_id % 10 = 0")
def vectors_upsert(spark, sf_dir):
    """Every tenth vector is put again, twice, and as many new ones."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_digest"), F.lit("m").alias("model_id"), F.lit("old").alias("version"))
    again = v.filter("chunk_digest % 10 = 0").withColumn("version", F.lit("new"))
    new = again.withColumn("chunk_digest", F.col("chunk_digest") + 1_000_000)
    return store.put_vectors(v, again.unionByName(again).unionByName(new)).select(F.col("chunk_digest").alias("vec_id"), "version")


@query(f"""WITH {_MSG} SELECT conv_id, sha256(string_agg('## ' || seq || ' · ' || role || chr(10) || chr(10) || regexp_replace(text, '(^|\\n)(#{{1,6}}(?:\\s|$)|(?:=+|-+)[ \\t]*(?:\\n|$))', '\\1\\\\\\2', 'g'), chr(10) || chr(10) ORDER BY seq) || chr(10)) AS digest FROM msg GROUP BY conv_id""")
def projected_chats(spark, sf_dir):
    return chats.projected(_messages(spark, sf_dir)).select("conv_id", F.sha2("text", 256).alias("digest"))


@query("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS ord, 's' || (l_suppkey % 4) || CASE WHEN l_partkey % 2 = 0 THEN '#m' || (l_partkey % 3) ELSE '' END AS target FROM lineitem), f AS (SELECT doc, target, min(ord) AS ord FROM c WHERE contains(target, '#') GROUP BY 1, 2)
SELECT doc, string_agg(target, ',' ORDER BY ord, target) AS citations FROM f GROUP BY doc""")
def message_citations(spark, sf_dir):
    part = F.col("l_partkey")
    target = F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"), F.when(part % 2 == 0, F.concat(F.lit("#m"), (part % 3).cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), target.alias("target"))
    return citations.message_citations(rows).select("doc", F.array_join("citations", ",").alias("citations"))


@query(f"""WITH {_POOL}, sh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || '/' || anchor)) AS d FROM k), mx AS (SELECT k.query_id, k.anchor, k.rank, k.score, sh.depth FROM k JOIN sh ON sh.query_id = k.query_id AND sh.d = k.rank),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * pow(1.2::DOUBLE, greatest(depth - 1, 0)), 6) DESC, rank) AS n FROM mx) {_TEN}""")
def rerank_shuffled_control(spark, sf_dir):
    return retrieval.shuffled_boost(_pool(spark, sf_dir), 1.2).select("query_id", "anchor", "rank")


@query("""WITH b AS (SELECT item_id, item_id % 3 = 0 AS rel, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM benchmark), k AS (SELECT *, list_slice(ts, 1, 64) AS s FROM b)
SELECT item_id AS query_id, CAST(1 + 1 + CASE WHEN len(ts) > 64 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(s, lambda t: t IN (@STOP@))) > 0 AND len(list_filter(s, lambda t: t NOT IN (@STOP@))) > 0 THEN 1 ELSE 0 END + CASE WHEN rel THEN 0 ELSE 1 END AS INTEGER) AS notes FROM k""")
def search_notes(spark, sf_dir):
    """How many remarks a search makes on each item; every third is asked with what is related."""
    asked = _asked(spark, sf_dir)
    return notes(asked, Settings(graph=True), related=F.col("query_id") % 3 == 0).select("query_id", F.size("notes").alias("notes"))


@query(_LEGS + """, hit AS (SELECT l.query_id, l.rank, l.anchor, len(regexp_extract_all(c.text, '""" + X.ESTIMATE.replace("'", "''") + """')) AS cost FROM lex l JOIN chunks c USING (anchor) WHERE l.rank <= 5),
w AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run FROM hit) SELECT query_id, rank, false AS omitted FROM w""")
def search_tool(spark, sf_dir):
    """The search as a call: five results under a budget that holds them all, each with its citation."""
    docs, chunks = _corpus(spark, sf_dir)
    cited = chunks.withColumn("first", F.lit(1)).withColumn("last", F.lit(2))
    settings = Settings(stems=False, include_candidate=True, weights={"text": 1.0})
    got = tool(_led(spark, sf_dir), docs, cited, settings, k=5, budget=1_000_000)
    return got.filter("uri like 'doc:%lines=1-2&digest=%'").select("query_id", "rank", "omitted")


@query("WITH @CORPUS@ SELECT path, count(*) AS anchors, min(anchor) AS first FROM chunks WHERE doc_id % 3 = 0 GROUP BY path")
def anchors_of_paths(spark, sf_dir):
    docs, chunks = _corpus(spark, sf_dir)
    got = lexical.anchors_of_paths(chunks.withColumn("path", X.document_of(F.col("anchor"))), docs.filter("doc_id % 3 = 0"))
    return got.select("path", F.size("anchors").cast("long").alias("anchors"), F.element_at("anchors", 1).alias("first"))
