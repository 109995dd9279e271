"""Compiling documents to a corpus's tables, all of them or only what a change reaches.

What follows from one document alone (its frontmatter, nodes, chunks and symbol sites) is made in a map over the documents
that are new or edited; for all others the rows of the version before are taken over. What documents say of each other
(links, uses of symbols, mentions of entities) is resolved again where it can have changed: in the documents that were
made again, and in those that refer to a name which one of these gives or gave. An incremental build has the same
tables as one from nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions.work import written
from loomdex.operators import graph, lifecycle, store, symbols
from loomdex.sources import frontmatter, markdown

#: How the references of the node table are called as links.
LINKS = {"link": "markdown_link", "wikilink": "wikilink", "embed": "embed"}
#: The tables of a version that a later build takes rows from.
REUSED = ("documents", "heads", "nodes", "chunks", "sites", "links", "edges", "symbols", "entities")
#: The keys of the tables, by which versions are compared.
KEYS = {"documents": ["path"], "heads": ["path"], "nodes": ["path", "ord"], "chunks": ["anchor"], "symbols": ["symbol"], "entities": ["slug"], "edges": ["edge_id"], "build": ["path"]}

LINK = "path string, anchor string, ord long, kind string, target string, to_path string, reason string, to_section string"


def with_digest(docs: DataFrame) -> DataFrame:
    return docs if "source_digest" in docs.columns else docs.withColumn("source_digest", X.digest(F.col("text")))


def only(rows: DataFrame, paths: DataFrame, how: str = "left_semi", of: str = "path") -> DataFrame:
    """The rows whose path is among paths (or, by left_anti, isn't)."""
    return rows.join(paths.select(F.col("path").alias(of)), of, how)


def edges_of(edges: DataFrame, types: tuple[str, ...], paths: DataFrame) -> DataFrame:
    """The edges of some types that start in none of paths."""
    from_path = F.regexp_extract("source", "^doc:([^#]*)", 1)
    return only(edges.filter(F.col("type").isin(*types)).withColumn("path", from_path), paths, "left_anti").drop("path")


def stated(heads: DataFrame, old_heads: DataFrame | None, touched: DataFrame) -> DataFrame:
    """kind, key: every name by which a link can mean a touched document, as it is or was."""
    out = touched.select(F.lit("path").alias("kind"), F.regexp_replace("path", "^/+", "").alias("key")).unionByName(touched.select(F.lit("base").alias("kind"), graph.stem(F.col("path")).alias("key")))
    for side in (heads, old_heads):
        if side is not None:
            own = only(side, touched)
            out = out.unionByName(own.select(F.lit("alias").alias("kind"), F.explode(F.transform("aliases", F.lower)).alias("key")))
            out = out.unionByName(own.filter("source is not null").select(F.lit("source").alias("kind"), graph.source_stem(F.col("source")).alias("key")))
    return out.distinct()


def reached(links: DataFrame, sources: DataFrame, names: DataFrame, touched: DataFrame) -> DataFrame:
    """path, ord of the links of untouched documents that one of names can mean, or that lead to a touched one."""
    k = graph.link_keys(links, sources)
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in (("path", "exact_key"), ("path", "rel_key"), ("base", "base_key"), ("source", "src_key"), ("alias", "alias_key"))])
    by_name = k.select("path", "ord", F.explode(keys).alias("k")).select("path", "ord", "k.kind", "k.key").join(names, ["kind", "key"], "left_semi")
    by_end = links.select("path", "ord", F.col("to_path").alias("_to")).join(touched.select(F.regexp_replace("path", "^/+", "").alias("_to")), "_to", "left_semi")
    return by_name.select("path", "ord").unionByName(by_end.select("path", "ord")).distinct()


def symbol_keys(sites: DataFrame) -> DataFrame:
    """path, lang, key: the names of a document's sites, and their last parts, by which uses mean definitions."""
    last = F.element_at(F.split("name", r"\."), -1)
    return sites.select("path", "lang", F.explode(F.array_distinct(F.array("name", last))).alias("key"))


def compile_documents(docs: DataFrame, env_digest: str = "", namespace: str = "default", previous: Callable[[str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of docs (path, text, perhaps source_digest): documents, nodes, chunks, edges, symbols, entities, quarantine,
    warnings; heads, sites and links, which a later build takes rows from; and build (path, action, resolved).

    A document whose frontmatter or blocks can't be read, or whose id another path has, is in quarantine and nowhere else,
    and is read again by every build. previous: gives the tables of the version before, by name. action: new, rebuilt,
    reused, removed or quarantined; resolved: whether any of the document's links, uses or mentions were looked up again.
    """
    docs = with_digest(docs)
    old = {n: previous(n) for n in REUSED} if previous else {}
    spark = docs.sparkSession
    no_paths = spark.createDataFrame([], "path string")
    if old:
        before = old["documents"].select("path", F.col("content_digest").alias("_digest"), F.col("env_digest").alias("_env"), F.col("namespace").alias("_space"))
        same = (F.col("source_digest") == F.col("_digest")) & (F.col("_env") == env_digest) & (F.col("_space") == namespace)
        unchanged = written(docs.select("path", "source_digest").join(before, "path").filter(same).select("path"), "unchanged")
        docs = written(only(docs, unchanged, "left_anti"), "fresh")

    def taken(name: str, new: DataFrame, paths: DataFrame) -> DataFrame:
        """new, and the rows that the version before has for the paths that haven't changed."""
        return new.unionByName(only(old[name], paths)) if old else new

    made = frontmatter.frontmatter(docs).withColumn("doc_id", F.coalesce("id", X.derived_ulid(F.col("path"))))
    heads = written(taken("heads", made, unchanged if old else no_paths), "heads")
    fresh_nodes = written(markdown.nodes(docs), "nodes")
    first = heads.groupBy("doc_id").agg(F.min("path").alias("_first"))
    broken = fresh_nodes.filter("kind = 'opaque' and error is not null").select("path", F.col("error").alias("reason"), F.lit("parse").alias("stage"))
    wrong = heads.filter("error is not null").select("path", F.col("error").alias("reason"), F.lit("guard").alias("stage"))
    twice = heads.join(first, "doc_id").filter("path <> _first").select("path", F.concat(F.lit("the id is that of "), "_first").alias("reason"), F.lit("guard").alias("stage"))
    quarantine = written(broken.unionByName(wrong).unionByName(twice).groupBy("path").agg(F.min(F.struct("stage", "reason")).alias("q")).select("path", "q.stage", "q.reason"), "quarantine")
    sound = lambda df: only(df, quarantine, "left_anti")
    heads = written(sound(heads), "sound-heads")
    made_paths = sound(docs.select("path"))
    kept = written(sound(unchanged), "kept") if old else no_paths
    gone = only(old["documents"].select("path"), kept, "left_anti") if old else no_paths
    touched = written(made_paths.unionByName(gone).distinct(), "touched")

    # what follows from a document alone
    new_heads, new_nodes = only(heads, made_paths), sound(fresh_nodes)
    new_chunks = written(sound(markdown.chunks(docs)).join(new_heads.select("path", "doc_id"), "path"), "chunks")
    title = new_nodes.filter("kind = 'heading' and level = 1").groupBy("path").agg(F.min_by("text", "ord").alias("_h1"))
    chunk_stats = new_chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    node_stats = new_nodes.groupBy("path").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.sum(F.size(F.filter("refs", lambda r: r["kind"].isin(*LINKS)))).alias("links_out"))
    documents = new_heads.join(title, "path", "left").join(chunk_stats, "path", "left").join(node_stats, "path", "left").join(docs.select("path", F.col("source_digest").alias("content_digest")), "path")
    origin = F.coalesce("origin", F.lit("authored"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    documents = documents.select(
        "doc_id", "path", store.title_of(F.col("title"), F.col("_h1"), F.col("path")).alias("title"), F.lit(namespace).alias("namespace"), "collection", "tags", "aliases", "supersedes", lifecycle.status_of(F.col("path")).alias("status"),
        store.trust_class(origin).alias("trust"), origin.alias("origin"), "source", "source_digest", "source_trust", "verified_by", "verified_at", "grounding", "properties", "warnings", "content_digest", F.lit(env_digest).alias("env_digest"),
        zero("tokens"), zero("headings"), zero("chunks"), zero("links_out"),
    )
    documents = written(taken("documents", documents, kept), "documents")
    nodes, chunks = taken("nodes", new_nodes, kept), taken("chunks", new_chunks, kept)
    spans = new_chunks.select("path", "anchor", F.col("first").alias("_a"), F.col("last").alias("_b"))
    placed = new_nodes.join(spans, "path", "left").filter(F.col("_a").isNull() | ((F.col("first") >= F.col("_a")) & (F.col("first") <= F.col("_b"))))
    placed = new_nodes.join(placed.groupBy("path", "ord").agg(F.min("anchor").alias("anchor")), ["path", "ord"], "left")
    sites = written(taken("sites", symbols.extract(placed), kept), "sites")

    # links
    refs = placed.select("path", "anchor", F.col("ord").alias("node"), F.posexplode("refs").alias("k", "r")).filter(F.col("r.kind").isin(*LINKS))
    kind = F.create_map(*[F.lit(x) for pair in LINKS.items() for x in pair])
    raw = refs.select("path", "anchor", (F.col("node").cast("long") * (1 << 32) + F.col("k")).alias("ord"), kind[F.col("r.kind")].alias("kind"), F.col("r.target").alias("target"))
    origins, sources = documents.select("path", "origin"), documents.filter("source is not null").select("path", F.col("source").alias("source_uri"))
    aliases = documents.select(F.explode("aliases").alias("alias"), "path")
    headings = nodes.filter("kind = 'heading'").select("path", X.slugged(F.col("text")).alias("slug"))
    relinked, held = no_paths, None
    if old:
        mine = only(old["links"], kept)
        again = written(reached(mine, sources, stated(heads, old["heads"], touched), touched), "reached")
        raw = raw.unionByName(mine.join(again, ["path", "ord"], "left_semi").select(*raw.columns))
        held, relinked = mine.join(again, ["path", "ord"], "left_anti"), again.select("path").distinct()
    if old:  # headings are slugged of documents that these links lead to only
        found = written(graph.resolve(raw, documents.select("path"), aliases, sources), "resolved")
        ends = found.filter("to_path is not null").select(F.col("to_path").alias("_end")).distinct()
        headings = nodes.filter("kind = 'heading'").withColumn("_end", F.regexp_replace("path", "^/+", "")).join(ends, "_end", "left_semi").select("path", X.slugged(F.col("text")).alias("slug"))
    else:
        found = graph.resolve(raw, documents.select("path"), aliases, sources)
    new_links = graph.fragments(found, headings, X.slugged(F.col("_fragment")))
    columns = [c.strip().split(" ")[0] for c in LINK.split(",")]
    links = written(new_links.select(*columns).unionByName(held.select(*columns)) if held is not None else new_links.select(*columns), "links")
    moved = written(made_paths.unionByName(relinked).unionByName(gone).distinct(), "moved")
    linked = graph.edges(only(links, moved) if old else links, origins, per_place=True).drop("ord")
    linked = linked.unionByName(edges_of(old["edges"], ("links_to", "cites"), moved).select(*linked.columns)) if old else linked
    linked = written(linked, "linked")
    declared = documents.select("path", F.explode("supersedes").alias("target"))

    # symbols: names in touched documents, as they are or were, reach whoever names them
    if old:
        names = written(symbol_keys(only(sites, made_paths)).unionByName(symbol_keys(only(old["sites"], gone))).select("lang", "key").distinct(), "names")
        reuse = written(symbol_keys(sites).join(names, ["lang", "key"], "left_semi").select("path").unionByName(made_paths).unionByName(gone).distinct(), "reused-names")
        symbol_edges = symbols.symbol_edges(sites, reuse).unionByName(edges_of(old["edges"], ("defines", "references"), reuse).select(*graph.EDGE))
        changed = names.select(symbols.symbol_id(F.col("lang"), F.col("key")).alias("symbol")).distinct()
        some = sites.withColumn("symbol", symbols.symbol_id(F.col("lang"), F.col("name"))).join(changed, "symbol", "left_semi").drop("symbol")
        folded = symbols.fold(some).unionByName(old["symbols"].join(changed, "symbol", "left_anti"))
    else:
        reuse, symbol_edges, folded = no_paths, symbols.symbol_edges(sites), symbols.fold(sites)

    # entities: all are folded from what documents declare; a passage is searched again if a name in it came or went
    tags = nodes.select("path", F.explode("refs").alias("r")).filter("r.kind = 'tag_ref'").select("path", F.col("r.target").alias("tag")).distinct()
    entities = written(symbols.fold_entities(symbols.declare_entities(documents, tags)), "entities")
    listed = lambda df: df.select("slug", F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("name")).distinct()
    passages = chunks.select(F.col("path").alias("doc_id"), "anchor", F.col("first").alias("ordinal"), "text", "kind")
    homes = entities.select("slug", F.explode("doc_refs").alias("doc_id"))
    searched = no_paths
    if old:
        now, then = listed(entities), listed(old["entities"])
        differ = written(now.exceptAll(then).unionByName(then.exceptAll(now)), "entity-names")
        met = graph.entity_mentions(differ, passages.join(kept.select(F.col("path").alias("doc_id")), "doc_id", "left_semi")).select(F.col("doc_id").alias("path"))
        searched = written(met.unionByName(made_paths).unionByName(gone).distinct(), "searched")
        passages = passages.join(searched.select(F.col("path").alias("doc_id")), "doc_id", "left_semi")
    mentions = graph.mention_edges(graph.entity_mentions(listed(entities), passages, declared=homes, overlapping=False), F.col("doc_id"))
    mentions = mentions.select(*graph.EDGE).unionByName(edges_of(old["edges"], ("mentions",), searched).select(*graph.EDGE)) if old else mentions

    edges = graph.merge_edges(linked, graph.supersedes(declared, documents.select("path"), origins), graph.part_of(linked), graph.derived_from(linked, origins), symbol_edges, mentions)
    unresolved = links.filter("to_path is null and reason <> 'external' or reason = 'no such heading'").select("path", "target", "reason")
    gaps = sites.filter("role = 'gap'").select("path", F.col("lang").alias("target"), F.lit("no grammar").alias("reason")).distinct()
    return {
        "documents": documents, "nodes": nodes, "chunks": chunks, "edges": edges, "symbols": folded, "entities": entities, "quarantine": quarantine, "warnings": unresolved.unionByName(gaps),
        "heads": heads, "sites": sites, "links": links, "build": actions(documents, quarantine, made_paths, old.get("documents"), [moved, reuse, searched]),
    }


def actions(documents: DataFrame, quarantine: DataFrame, made: DataFrame, before: DataFrame | None, looked: list[DataFrame]) -> DataFrame:
    """path, action, resolved of every document of this version or the one before."""
    rows = documents.select("path", F.lit(True).alias("_now")).join(made.select("path", F.lit(True).alias("_made")), "path", "left")
    was = (before if before is not None else documents.limit(0)).select("path", F.lit(True).alias("_was"))
    rows = rows.join(was, "path", "full_outer").join(quarantine.select("path", F.lit(True).alias("_bad")), "path", "full_outer")
    again = looked[0].select("path").unionByName(looked[1].select("path")).unionByName(looked[2].select("path")).distinct().withColumn("_looked", F.lit(True))
    action = F.when(F.col("_bad"), "quarantined").when(F.col("_now").isNull(), "removed").when(F.col("_made").isNull(), "reused").when(F.col("_was"), "rebuilt").otherwise("new")
    return rows.join(again, "path", "left").select("path", action.alias("action"), (F.coalesce("_looked", F.lit(False)) & F.coalesce("_now", F.lit(False))).alias("resolved"))
