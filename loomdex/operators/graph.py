"""Links, their resolution, typed edges and walks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X

#: Schemes whose targets leave the corpus.
EXTERNAL = ("http", "https", "mailto", "ftp", "ftps", "data", "tel", "file")
#: Fixed value: the deepest walk.
MAX_DEPTH = 3


def external(target: Column) -> Column:
    return F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*EXTERNAL)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def unique_keys(docs: DataFrame, key: Column, name: str) -> DataFrame:
    """key, one path, how many paths: a row for each key, grouped before any join."""
    return docs.select(key.alias(f"{name}_key"), "path").distinct().groupBy(f"{name}_key").agg(F.min("path").alias(f"{name}_path"), F.count("*").alias(f"{name}_n"))


def source_stem(uri: Column) -> Column:
    """Where a local source lies, without its suffix, in lower case; empty for sources of other schemes."""
    path = F.regexp_replace(uri, "^file:", "")
    flat = X.folded_path(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.when(path.rlike("^[^/]*:"), "").otherwise(F.regexp_replace(flat, r"\.[^./]*$", ""))


#: The kinds of links whose targets may be relative to the document's folder.
RELATIVE = ("markdown_link", "frontmatter")


def link_keys(links: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """links with the names by which their targets may be known: bare, exact_key, rel_key, base_key, alias_key and src_key."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rows = links.withColumn("bare", F.regexp_replace("target", r"#.*$", "")).withColumn("exact_key", F.regexp_replace("bare", "^/+", ""))
    rows = rows.withColumn("rel_key", X.folded_path(F.concat(folder, F.col("bare")))).withColumn("base_key", stem(F.col("bare"))).withColumn("alias_key", F.lower("bare"))
    if sources is None:
        return rows.withColumn("src_key", F.lit(None).cast("string"))
    rows = rows.join(sources.select("path", source_stem(F.col("source_uri")).alias("_stem")).filter("_stem <> ''"), "path", "left")
    beside = source_stem(F.concat(F.coalesce(F.regexp_extract("_stem", "^(.*/)[^/]*$", 1), F.lit("")), "bare"))
    return rows.withColumn("src_key", F.when(F.col("_stem").isNotNull(), beside))


def resolve(links: DataFrame, docs: DataFrame, aliases: DataFrame | None = None, sources: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """links (path, target, perhaps kind) with to_path and reason.

    In order: a bare fragment is the source itself; the exact path; for Markdown links and frontmatter, the path relative
    to the source's folder; the document whose own source lies where the target lies from this one's source; a unique base
    name, where an ambiguous one ends the search; a unique alias. Otherwise the reason says why not.

    sources: path, source_uri of documents that came from elsewhere; files: path of what lies beside the documents, to which
    a link isn't unresolved but no edge either.
    """
    rows = link_keys(links if "kind" in links.columns else links.withColumn("kind", F.lit("markdown_link")), sources)
    plain = docs.withColumn("path", F.regexp_replace("path", "^/+", ""))
    exact = plain.select(F.col("path").alias("exact_key"), F.lit(True).alias("is_exact")).distinct()
    near = exact.withColumnsRenamed({"exact_key": "rel_key", "is_exact": "is_rel"})
    base = unique_keys(plain, stem(F.col("path")), "base")
    got = rows.join(exact, "exact_key", "left").join(near, "rel_key", "left").join(base, "base_key", "left")
    if sources is None:
        got = got.withColumn("src_path", F.lit(None).cast("string"))
    else:
        stems = sources.select("path", source_stem(F.col("source_uri")).alias("_stem")).filter("_stem <> ''")
        known = stems.groupBy(F.col("_stem").alias("src_key")).agg(F.min("path").alias("src_path"))
        got = got.join(known, "src_key", "left")
    if aliases is None:
        got = got.withColumn("alias_path", F.lit(None).cast("string")).withColumn("alias_n", F.lit(None).cast("long"))
    else:
        got = got.join(unique_keys(aliases, F.lower("alias"), "alias"), "alias_key", "left")
    if files is None:
        got = got.withColumn("is_file", F.lit(False))
    else:
        some = files.select(F.regexp_replace("path", "^/+", "").alias("exact_key"), F.lit(True).alias("_here")).distinct()
        got = got.join(some, "exact_key", "left").join(some.withColumnsRenamed({"exact_key": "rel_key", "_here": "_beside"}), "rel_key", "left")
        got = got.withColumn("is_file", F.coalesce("_here", F.lit(False)) | F.coalesce("_beside", F.lit(False)))
    out = F.col("external")
    got = got.withColumn("external", external(F.col("target")))
    to = (
        F.when(out, None).when(F.col("bare") == "", F.regexp_replace("path", "^/+", "")).when(F.col("is_exact"), F.col("exact_key")).when(F.col("is_rel") & F.col("kind").isin(*RELATIVE), F.col("rel_key"))
        .when(F.col("src_path").isNotNull(), F.col("src_path")).when(F.col("base_n") == 1, F.col("base_path")).when(F.col("base_n") > 1, None).when(F.col("alias_n") == 1, F.col("alias_path"))
    )
    why = F.when(out, "external").when(F.col("to_path").isNotNull(), "resolved").when(F.col("is_file"), "not a document").when(F.col("base_n") > 1, "ambiguous name").when(F.col("alias_n") > 1, "ambiguous alias").otherwise("no such document")
    return got.withColumn("to_path", to).withColumn("reason", why).select(*links.columns, "to_path", "reason")


def fragments(resolved: DataFrame, headings: DataFrame, slug: Column) -> DataFrame:
    """resolved with to_section, the slug of the heading that a link's fragment names, if the target has it; else a reason.
    headings: path, slug; slug: of the fragment (X.slugged(X.fragment()) for any text, X.slug for plain letters)."""
    rows = resolved.withColumn("_fragment", F.regexp_extract("target", "#(.*)$", 1)).withColumn("_slug", F.when(F.col("_fragment") != "", slug))
    known = headings.select(F.regexp_replace("path", "^/+", "").alias("to_path"), F.col("slug").alias("_slug"), F.col("slug").alias("to_section")).distinct()
    got = rows.join(known, ["to_path", "_slug"], "left")
    lost = F.col("to_path").isNotNull() & F.col("_slug").isNotNull() & F.col("to_section").isNull()
    return got.withColumn("reason", F.when(lost, "no such heading").otherwise(F.col("reason"))).select(*resolved.columns, "to_section")


def doc_ref(path: Column) -> Column:
    return F.concat(F.lit("doc:"), F.regexp_replace(path, "^/+", ""))


def in_folder(path: Column, folder: str) -> Column:
    return path.rlike(rf"(^|/){folder}/")


EDGE = ("edge_id", "source", "target", "type", "status", "provenance", "anchor")


def edge_rows(found: DataFrame) -> DataFrame:
    """Each edge once. found: source, target, type, status, provenance (its kind), anchor, perhaps ord; its first place."""
    named = found.withColumn("edge_id", X.edge_id(F.col("source"), F.col("target"), F.col("type"), F.col("provenance"), F.col("anchor")))
    rest = [c for c in EDGE if c != "edge_id"]
    first = [F.min("ord").alias("ord")] if "ord" in found.columns else []
    return named.groupBy("edge_id").agg(*[F.first(c).alias(c) for c in rest], *first)  # all but the place follow from the id


def edges(resolved: DataFrame, origins: DataFrame | None = None, per_place: bool = False) -> DataFrame:
    """edge_id, source, target, type, status, provenance, anchor, ord of resolved links (path, target, to_path, ord, perhaps
    kind, to_section, anchor). A link into evidence from outside it cites; all others are links. Links of ingested
    documents are extracted, others authored. origins: path, origin; per_place: whether the anchor a link stands at is part
    of its edge."""
    found = resolved.filter(F.col("to_path").isNotNull())
    has = lambda c, other: F.col(c) if c in found.columns else other
    section = has("to_section", F.lit(None).cast("string"))
    target = F.concat(doc_ref(F.col("to_path")), F.when(section.isNotNull(), F.concat(F.lit("#"), section)).otherwise(""))
    kind = F.when(in_folder(F.col("to_path"), "evidence") & ~in_folder(F.col("path"), "evidence"), "cites").otherwise("links_to")
    rows = found.select(F.col("path"), doc_ref(F.col("path")).alias("source"), target.alias("target"), kind.alias("type"), has("kind", F.lit("markdown_link")).alias("provenance"), (has("anchor", F.lit(None)) if per_place else F.lit(None)).cast("string").alias("anchor"), "ord")
    return edge_rows(with_status(rows, origins).drop("path"))


def with_status(rows: DataFrame, origins: DataFrame | None) -> DataFrame:
    if origins is None:
        return rows.withColumn("status", F.lit("authored"))
    known = origins.select("path", F.col("origin").alias("_origin"))
    return rows.join(known, "path", "left").withColumn("status", F.when(F.col("_origin") == "ingested", "extracted").otherwise("authored")).drop("_origin")


def supersedes(declared: DataFrame, docs: DataFrame, origins: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """Edges of the documents (path, target) that say they replace another; external targets and themselves are dropped."""
    got = resolve(declared.withColumn("kind", F.lit("frontmatter")), docs, **more).filter("to_path is not null").withColumn("path", F.regexp_replace("path", "^/+", "")).filter("path <> to_path")
    rows = got.select("path", doc_ref(F.col("path")).alias("source"), doc_ref(F.col("to_path")).alias("target"), F.lit("supersedes").alias("type"), F.lit("frontmatter").alias("provenance"), F.lit(None).cast("string").alias("anchor"))
    return edge_rows(with_status(rows, origins).drop("path"))


def part_of(edge_table: DataFrame) -> DataFrame:
    """An edge from each section that an edge names to its document."""
    ends = edge_table.select(F.col("target").alias("source")).unionByName(edge_table.select("source")).distinct().filter(F.col("source").rlike("^doc:[^#]+#."))
    fixed = {"type": "part_of", "status": "authored", "provenance": "heading"}
    return edge_rows(ends.withColumn("target", F.split_part("source", F.lit("#"), F.lit(1))).withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("anchor", F.lit(None).cast("string")))


def derived_from(edge_table: DataFrame, origins: DataFrame) -> DataFrame:
    """An edge from each synthesised document to each document that it cites."""
    made = origins.filter("origin = 'synthesized'").select(doc_ref(F.col("path")).alias("source")).distinct()
    cited = edge_table.filter("type = 'cites'").join(made, "source", "left_semi").select("source", F.split_part("target", F.lit("#"), F.lit(1)).alias("target")).distinct()
    fixed = {"type": "derived_from", "status": "authored", "provenance": "frontmatter"}
    return edge_rows(cited.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("anchor", F.lit(None).cast("string")))


def merge_edges(*groups: DataFrame) -> DataFrame:
    """The edges of all groups, each once."""
    rows = [g.select(*EDGE) for g in groups]
    return functools.reduce(DataFrame.unionByName, rows).dropDuplicates(["edge_id"])


def target_refs(targets: DataFrame, docs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """target, ref, error: the node that a path, an anchor, a citation's URI, a doc: or a sym: reference means. docs: doc_id, path; symbols:
    symbol. What names nothing has no ref and the error says so."""
    t = F.col("target")
    path = F.when(t.startswith("doc:"), F.regexp_extract(t, r"^doc:([^?]*)", 1)).otherwise(F.split_part(t, F.lit("#"), F.lit(1)))
    rows = targets.select("target").distinct().withColumn("_path", F.split_part(path, F.lit("#"), F.lit(1)))
    known = docs.select(F.regexp_replace("path", "^/+", "").alias("_path"), F.lit(True).alias("_doc")).distinct()
    rows = rows.join(known, "_path", "left")
    named = symbols.select(F.col("symbol").alias("target"), F.lit(True).alias("_sym")).distinct() if symbols is not None else targets.limit(0).select("target", F.lit(True).alias("_sym"))
    rows = rows.join(named, "target", "left")
    ref = F.when(t.startswith("sym:"), F.when(F.col("_sym"), t)).when(t.startswith("doc:"), F.concat(F.lit("doc:"), path)).when(F.col("_doc"), F.concat(F.lit("doc:"), F.col("_path")))
    error = F.when(F.col("ref").isNotNull(), None).when(t.startswith("sym:"), "no such symbol").otherwise("no such document")
    return rows.withColumn("ref", ref).withColumn("error", error).select("target", "ref", "error")


def incidence(edge_table: DataFrame) -> DataFrame:
    """node, other, direction, type, edge_id: each edge from both of its ends."""
    out = edge_table.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"), "type", "edge_id")
    return out.unionByName(edge_table.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction"), "type", "edge_id"))


def neighbours(origins: DataFrame, edge_table: DataFrame, depth: int = 1, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """origin, node, depth: nodes met within depth steps in either direction, at their least depth.

    origins: origin. At most MAX_DEPTH joins; each drops what was met before.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is 1 to {MAX_DEPTH}")
    step = incidence(edge_table if types is None else edge_table.filter(F.col("type").isin(*types))).select("node", "other").distinct()
    met = origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    last = met
    for d in range(1, depth + 1):
        new = last.select("origin", "node").join(step, "node").select("origin", F.col("other").alias("node")).distinct()
        last = new.join(met.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d))
        met = met.unionByName(last)
    met = met.filter("depth > 0")
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "node"))
        met = met.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
    return met


def nodes_of(anchor: Column) -> Column:
    """The nodes that a chunk belongs to: its section, then its document."""
    path, slug = X.document_of(anchor), F.regexp_extract(anchor, "#(.*)/[^/]*$", 1)
    both = F.array(F.when(slug != "", F.concat(F.lit("doc:"), path, F.lit("#"), slug)), F.concat(F.lit("doc:"), path))
    return F.filter(both, lambda x: x.isNotNull())


def round_robin(seeds: DataFrame, edge_table: DataFrame, most: int = 10, hint: str | None = None) -> DataFrame:
    """query_id, node, seed_rank, round, via: nodes one step from the seeds, taken in turn from each seed; a node counts
    once, where it is first proposed, though its further edges use up turns.

    seeds: query_id, seed_rank, node, perhaps node_ord (the order of a seed's own nodes, which it doesn't propose). hint: how
    the edges are to be joined.
    """
    at = incidence(edge_table)
    rows = seeds if "node_ord" in seeds.columns else seeds.withColumn("node_ord", F.lit(0))
    own = rows.select("query_id", "seed_rank", F.col("node").alias("other"))
    met = rows.join(at if hint is None else at.hint(hint), "node").join(own, ["query_id", "seed_rank", "other"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("query_id", "seed_rank").orderBy("node_ord", F.desc("direction"), "other", "type", "edge_id"))
    numbered = met.withColumn("round", turn)
    first = numbered.groupBy("query_id", F.col("other").alias("node")).agg(F.min(F.struct("round", "seed_rank", "type")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at.round", "at.seed_rank", "node"))
    return first.withColumn("_n", place).filter(F.col("_n") <= most).select("query_id", "node", "at.seed_rank", "at.round", F.col("at.type").alias("via"))


# Symbols and entities


def fold_symbols(definitions: DataFrame) -> DataFrame:
    """symbol, kind, defined_in, doc_refs from (symbol, kind, direct, path, line, anchor): the defining place is the
    first direct one; references are the sorted union of anchors."""
    first = F.min(F.struct((~F.col("direct")).alias("indirect"), F.col("path").alias("path"), F.col("line").alias("line"), F.col("kind").alias("kind"), F.col("anchor").alias("anchor")))
    folded = definitions.groupBy("symbol").agg(first.alias("d"), F.array_sort(F.collect_set("anchor")).alias("doc_refs"))
    return folded.select("symbol", "d.kind", F.col("d.anchor").alias("defined_in"), "doc_refs")


def ngrams(tokens: str, n: int) -> Column:
    """The runs of n tokens of an array of at least n, joined by a space."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda k: F.array_join(F.slice(tokens, k, n), " "))


def entity_mentions(entities: DataFrame, rows: DataFrame, shortest: int = 4, declared: DataFrame | None = None, overlapping: bool = True) -> DataFrame:
    """slug, doc_id, anchor, ordinal: the first passage of each document that names each entity.

    entities: slug, name; rows: doc_id, anchor, ordinal, text, perhaps kind. Names are runs of index tokens, so a name meets
    a passage by an equality on its n-gram, whatever the number of names; names under ``shortest`` letters aren't
    searched, and neither are chunks of code. overlapping: whether names that overlap in a passage all count, or only the
    one that begins first and of those the longest. declared: slug, doc_id of documents that declare an entity, which don't mention it.
    """
    names = entities.select("slug", X.index_tokens(F.col("name")).alias("tokens"), F.length("name").alias("letters")).filter((F.col("letters") >= shortest) & (F.size("tokens") > 0))
    names = names.select("slug", F.array_join("tokens", " ").alias("gram"), F.size("tokens").alias("n")).distinct()
    lengths = [r[0] for r in names.select("n").distinct().orderBy("n").collect()]
    prose = rows.filter("kind <> 'code'") if "kind" in rows.columns else rows
    tokens = prose.select("doc_id", "anchor", "ordinal", X.index_tokens(F.col("text")).alias("t"))
    grams = None
    for n in lengths:
        one = tokens.filter(F.size("t") >= n).select("doc_id", "anchor", "ordinal", F.posexplode(ngrams("t", n)).alias("at", "gram"))
        grams = one if grams is None else grams.unionByName(one)
    if grams is None:
        return rows.limit(0).select(F.lit("").alias("slug"), "doc_id", "anchor", "ordinal")
    hit = grams.join(names, "gram")
    if not overlapping:
        listed = hit.groupBy("doc_id", "anchor", "ordinal").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "slug"))).alias("c"))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept"))
        fits = lambda s, x: x["at"] >= s["end"]
        step = lambda s, x: F.struct(F.when(fits(s, x), x["at"] - x["less"]).otherwise(s["end"]).cast("int").alias("end"), F.when(fits(s, x), F.concat(s["kept"], F.array(x["slug"]))).otherwise(s["kept"]).alias("kept"))
        hit = listed.select("doc_id", "anchor", "ordinal", F.explode(F.array_distinct(F.aggregate("c", start, step)["kept"])).alias("slug"))
    hit = hit.groupBy("slug", "doc_id").agg(F.min(F.struct("ordinal", "anchor")).alias("place"))
    found = hit.select("slug", "doc_id", "place.anchor", "place.ordinal")
    return found if declared is None else found.join(declared.select("slug", "doc_id").distinct(), ["slug", "doc_id"], "left_anti")


def mention_edges(mentions: DataFrame, path: Column) -> DataFrame:
    """An edge from each document to each entity that its prose mentions."""
    return edge_rows(mentions.select(doc_ref(path).alias("source"), F.concat(F.lit("ent:"), "slug").alias("target"), F.lit("mentions").alias("type"), F.lit("extracted").alias("status"), F.lit("prose").alias("provenance"), "anchor"))
