"""Citations: URIs, fetching, the citation contract, grounding, and the context-cost comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import retrieval
from loomdex.operators.evaluation import sign_test


def uri(anchor: Column, first: Column, last: Column, digest: Column) -> Column:
    return F.concat(F.lit("doc:"), anchor, F.lit("?lines="), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("&digest="), F.substring(F.regexp_replace(digest, "^sha256:", ""), 1, 12))


def parse(uris: DataFrame, column: str = "uri") -> DataFrame:
    """anchor, first, last, digest, status of each URI: unknown keys are ignored, malformed lines are an error, a malformed
    digest is ignored."""
    body, tail = F.regexp_extract(column, r"^doc:([^?]+)", 1), F.regexp_extract(column, r"\?(.*)$", 1)
    value = lambda key: F.regexp_extract(tail, rf"(?:^|&){key}=([^&]*)", 1)
    lines, digest = value("lines"), value("digest")
    span = lambda k: F.regexp_extract(lines, r"^(\d+)-(\d+)$", k)
    good = (lines == "") | (lines.rlike(r"^\d{1,9}-\d{1,9}$") & (F.try_to_number(span(1), F.lit("999999999")) <= F.try_to_number(span(2), F.lit("999999999"))))
    status = F.when(body == "", "not a citation").when(~F.coalesce(good, F.lit(False)), "malformed lines").otherwise("ok")
    got = uris.withColumn("anchor", body).withColumn("status", status)
    number = lambda k: F.when((F.col("status") == "ok") & (lines != ""), span(k)).cast("int")
    return got.withColumn("first", number(1)).withColumn("last", number(2)).withColumn("digest", F.when(digest.rlike("^[0-9a-f]{12}$"), digest))


def fetch(wanted: DataFrame, chunks: DataFrame, mode: str = "chunk") -> DataFrame:
    """anchor, found, text: the chunk of each anchor, or the first chunk of the nearest section above it that still has
    chunks; mode section or document: all chunks of the found one's section or document, in order, as one text.

    wanted: anchor; chunks: anchor, text. Ancestors are the prefixes of an anchor's slugs; the empty one is the document.
    """
    path, slugs = F.split_part("anchor", F.lit("#"), F.lit(1)), F.split(F.split_part("anchor", F.lit("#"), F.lit(2)), "/")
    above = F.transform(F.sequence(F.size(slugs) - 1, F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.concat(path, F.lit("#"), F.array_join(F.slice(slugs, 1, n), "/")).alias("section")))
    exact = wanted.join(chunks, "anchor").select("anchor", F.col("anchor").alias("found"))
    lost = wanted.join(chunks.select("anchor"), "anchor", "left_anti").select("anchor", F.explode(above).alias("a")).select("anchor", "a.*")
    first = chunks.select(F.regexp_replace("anchor", "/[^/]*$", "").alias("section"), F.col("anchor").alias("found"))
    near = lost.join(first.groupBy("section").agg(F.min("found").alias("found")), "section").groupBy("anchor").agg(F.max_by("found", "depth").alias("found"))
    got = exact.unionByName(near)
    if mode == "chunk":
        return got.join(chunks.withColumnRenamed("anchor", "found"), "found").select("anchor", "found", "text")
    key = {"section": X.section_of, "document": X.document_of}[mode]
    place = F.regexp_extract("anchor", "/([0-9]+)$", 1).cast("int")
    whole = chunks.withColumn("_k", key(F.col("anchor"))).groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.regexp_replace("anchor", "/[^/]*$", "").alias("s"), place.alias("p"), "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return got.withColumn("_k", key(F.col("found"))).join(whole, "_k").select("anchor", "found", "text")


def fetch_cited(uris: DataFrame, chunks: DataFrame, mode: str = "chunk") -> DataFrame:
    """uri, status, found, text, drift of each citation: what it says now, and whether that has moved or been rewritten since.
    chunks: anchor, text, chunk_digest, first, last. A chunk that is gone gives the nearest above it."""
    cited = parse(uris)
    now = chunks.select("anchor", F.regexp_replace("chunk_digest", "^sha256:", "").alias("now"), F.col("first").alias("now_first"), F.col("last").alias("now_last"))
    got = fetch(cited.filter("status = 'ok'").select("anchor").distinct(), chunks.select("anchor", "text"), mode)
    rows = cited.join(got, "anchor", "left").join(now, "anchor", "left")
    rewritten = F.col("digest").isNotNull() & ~F.col("now").startswith(F.col("digest"))
    moved = F.col("first").isNotNull() & ((F.col("first") != F.col("now_first")) | (F.col("last") != F.col("now_last")))
    drift = F.when(F.col("status") != "ok", None).when(F.col("now").isNull(), "gone").when(moved & rewritten, "moved and rewritten").when(moved, "moved").when(rewritten, "rewritten").otherwise("current")
    return rows.select("uri", F.when((F.col("status") == "ok") & F.col("found").isNull(), "no such document").otherwise(F.col("status")).alias("status"), "found", "text", drift.alias("drift"))


def contract(claims: DataFrame, targets: DataFrame, least: int = 5, sections_only: DataFrame | None = None) -> DataFrame:
    """path, claims, cited, dangling, coverage, holds. claims: path, ord, text (with [[targets]]); targets: name.

    A claim has ``least`` words or more; every link must resolve and every claim must have one. sections_only: name of
    documents of which only sections may be cited, by [[name#section]].
    """
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"\[\[[^\]]*\]\]", " "), r"\s+"), lambda w: w != ""))
    rows = claims.filter(words >= least).withColumn("links", F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)"), 1))
    each = rows.select("path", "ord", F.explode("links").alias("link")).withColumn("name", F.trim(F.regexp_replace("link", "#.*$", "")))
    known = each.join(targets.select("name").distinct().withColumn("_k", F.lit(1)), "name", "left")
    if sections_only is not None:
        known = known.join(sections_only.select("name").distinct().withColumn("_s", F.lit(1)), "name", "left")
        known = known.withColumn("_k", F.when(F.col("_s").isNull() | F.col("link").rlike("#."), F.col("_k")))
    known = known.groupBy("path", "ord").agg(F.count("_k").alias("good"), F.count("*").alias("all"))
    by = rows.join(known, ["path", "ord"], "left").groupBy("path").agg(F.count("*").alias("claims"), F.count_if(F.coalesce("good", F.lit(0)) > 0).alias("cited"), F.sum(F.coalesce(F.col("all") - F.col("good"), F.lit(0))).alias("dangling"))
    coverage = F.round(F.col("cited") / F.col("claims"), 6)
    return by.withColumn("coverage", coverage).withColumn("holds", (F.col("dangling") == 0) & (F.col("cited") == F.col("claims")))


def message_citations(citations: DataFrame) -> DataFrame:
    """doc, citations: of each document the citations that name a message (a fragment), each once, in order of first use.
    citations: doc, ord, target."""
    some = citations.filter(F.col("target").rlike("#.")).groupBy("doc", "target").agg(F.min("ord").alias("ord"))
    return some.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("citations"))


def grounding(covered: DataFrame, entailed: DataFrame, coverage: float = 0.95, entailment: float = 0.9) -> DataFrame:
    """path, score, blockers: the weaker of coverage and entailment, and what keeps a document from promotion.

    covered: path, coverage; entailed: path, entailment (from any judge); a document without a judgement is blocked.
    """
    both = covered.join(entailed, "path", "left")
    some = F.array(F.when(F.col("coverage") < coverage, "coverage"), F.when(F.col("entailment").isNull(), "not judged"), F.when(F.col("entailment") < entailment, "entailment"))
    return both.select("path", F.least("coverage", F.coalesce("entailment", F.lit(0.0))).alias("score"), F.filter(some, lambda x: x.isNotNull()).alias("blockers"))


def trust_of(sources: DataFrame, patterns: list[tuple[str, str]], default: str) -> DataFrame:
    """sources (uri) with trust: that of the longest pattern that the URI contains."""
    listed = sorted(patterns, key=lambda p: (-len(p[0]), p[0]))
    out = F.lit(default)
    for pattern, trust in reversed(listed):
        out = F.when(F.col("uri").contains(pattern), trust).otherwise(out)
    return sources.withColumn("trust", out)


def context_cost(hits: DataFrame, required: DataFrame, budget: int) -> DataFrame:
    """task_id, found, tokens: whether the packed context of each task holds all that it requires, and what it costs. A hit
    that doesn't fit is skipped, and the next ones may still fit.

    hits: task_id, rank, anchor, tokens; required: task_id, anchor.
    """
    packed = retrieval.pack(hits.withColumnRenamed("task_id", "query_id"), budget).withColumnRenamed("query_id", "task_id")
    held = packed.select("task_id", F.explode("kept").alias("anchor"))
    missing = required.join(held, ["task_id", "anchor"], "left_anti").groupBy("task_id").agg(F.count("*").alias("missing"))
    tasks = required.select("task_id").distinct()
    cost = packed.select("task_id", F.col("spent").alias("tokens"))
    return tasks.join(cost, "task_id", "left").join(missing, "task_id", "left").select("task_id", F.col("missing").isNull().alias("found"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def window_reads(sections: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """task_id, doc, first, last, tokens: what a reader gets of each document it opens: all of a small one, else the section
    of the hit, grown section by section, first by what follows and then by what stands before, while it fits the window.

    sections: doc, ord (from 0), tokens; hits: task_id, doc, ord of the best section.
    """
    listed = sections.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tokens"))), lambda x: x["tokens"].cast("long")).alias("sizes"))
    rows = hits.join(listed, "doc").withColumn("all", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    size = lambda k: F.get("sizes", k)
    start = F.struct(F.col("ord").cast("int").alias("first"), F.col("ord").cast("int").alias("last"), size(F.col("ord").cast("int")).alias("tokens"))

    def grow(s: Column, _: Column) -> Column:
        after, before = size(s["last"] + 1), F.when(s["first"] > 0, size(s["first"] - 1))
        down, up = F.coalesce(s["tokens"] + after <= window, F.lit(False)), F.coalesce(s["tokens"] + before <= window, F.lit(False))
        step = lambda yes_down, yes_up, no: F.when(down, yes_down).when(up, yes_up).otherwise(no)
        return F.struct(step(s["first"], s["first"] - 1, s["first"]).alias("first"), step(s["last"] + 1, s["last"], s["last"]).alias("last"), step(s["tokens"] + after, s["tokens"] + before, s["tokens"]).alias("tokens"))

    grown = F.aggregate("sizes", start, grow)
    whole = F.struct(F.lit(0).alias("first"), (F.size("sizes") - 1).alias("last"), F.col("all").alias("tokens"))
    return rows.select("task_id", "doc", F.when(F.col("all") <= window, whole).otherwise(grown).alias("g")).select("task_id", "doc", "g.*")


def verdict(ours: DataFrame, theirs: DataFrame, lead: int = 2, ratio: float = 0.5, p: float = 0.05) -> DataFrame:
    """wins, losses, lead, p, ratio of median tokens, passed: one row. Both: task_id, found, tokens. p is the exact
    one-sided sign test."""
    o, t = (x.select("task_id", F.col("found").alias(f"{n}_f"), F.col("tokens").alias(f"{n}_t")) for x, n in ((ours, "o"), (theirs, "t")))
    both = o.join(t, "task_id")
    got = both.agg((F.median("o_t") / F.median("t_t")).alias("ratio"))
    test = sign_test(both.select(F.lit(1).alias("_g"), F.col("o_f").cast("int").alias("a"), F.col("t_f").cast("int").alias("b")), "_g", "a", "b").drop("_g")
    out = test.crossJoin(got).withColumn("lead", F.col("wins") - F.col("losses"))  # one row each
    return out.withColumn("passed", (F.col("lead") > lead) & (F.col("p") < p) & (F.col("ratio") <= ratio))
