"""Vector leg, fusion, filters, packing and the re-rankers, over tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion and the depth of each leg.
RRF_K = 60
DEPTH = 50


def unit(vector: Column) -> Column:
    """A vector at length 1; null for one that is null, zero, or has a component that is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(~F.coalesce(bad, F.lit(False)) & (norm > 0), F.transform(x, lambda v: v / norm))


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = 512, part: int = 16384) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine neighbours, ties (of nine digits) by vec_id. Both sides: id, embedding.

    Vectors without a direction (null, zero, or with a component that is null or not finite) take no part, and vectors
    meet those of their own dimension. Queries are packed into blocks and met with the vectors of each part of the table as one
    matrix product of block * part scores, of which the best are selected, not sorted.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    known = lambda df: df.select("id", unit(F.col("embedding")).alias("u")).filter("u is not null").withColumn("dim", F.size("u"))
    q, v = known(queries), known(vectors)
    parts, blocks = max(1, -(-vectors.count() // part)), max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    q_blocks = q.withColumn("blk", deal(blocks)).groupBy("dim", "blk").agg(F.collect_list(F.struct("id", "u")).alias("qs")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = v.withColumn("part", deal(parts)).groupBy("dim", "part").agg(F.collect_list(F.struct("id", "u")).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, vs in zip(b.column(0), b.column(1), strict=True):
                qi, vi = qs.values.field("id").to_numpy(), vs.values.field("id").to_numpy()
                qm, vm = (x.values.field("u").flatten().to_numpy().reshape(n, -1) for x, n in ((qs, len(qi)), (vs, len(vi))))
                scores = qm @ vm.T
                near = scores.round(9)
                kth = np.partition(near, len(vi) - k, axis=1)[:, len(vi) - k] if len(vi) > k else np.full(len(qi), -np.inf)
                row, at = np.nonzero(near >= kth[:, None])  # the k-th best and all that tie with it
                order = np.lexsort((vi[at], -near[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(vi[at]), pa.array(scores[row, at])], schema=schema)

    pairs = q_blocks.join(held, ["dim", "part"]).select("qs", "vs").mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("score", F.round(F.round("score", 9), 6))


def by_digest(hits: DataFrame, digests: DataFrame, k: int) -> DataFrame:
    """query_id, anchor, score, rank: the chunks of the digests that were found, since chunks of one text share a vector.
    hits: query_id, chunk_digest, score; digests: chunk_digest, anchor."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "anchor"))
    return hits.join(digests, "chunk_digest").select("query_id", "anchor", "score", place.alias("rank")).filter(F.col("rank") <= k)


def rrf(legs: DataFrame, limit: int, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, anchor, score, rank, n_legs, legs, ranks from legs (query_id, leg, anchor, rank): each leg adds weight /
    (60 + rank); legs names those that found an anchor, ranks has its place in each."""
    w = F.lit(1.0)
    for leg, x in (weights or {}).items():
        w = F.when(F.col("leg") == leg, F.lit(x)).otherwise(w)
    # decimals add up to the same sum in any order
    part = F.round(w / (RRF_K + F.col("rank")), 12).cast("decimal(20,12)")
    found = F.array_sort(F.collect_list(F.struct("leg", "rank")))
    fused = legs.groupBy("query_id", "anchor").agg(F.sum(part).cast("double").alias("score"), F.count("*").alias("n_legs"), found.alias("_f"))
    fused = fused.withColumn("legs", F.transform("_f", lambda x: x["leg"])).withColumn("ranks", F.map_from_arrays("legs", F.transform("_f", lambda x: x["rank"]))).drop("_f")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "anchor"))
    return fused.withColumn("rank", place).filter(F.col("rank") <= limit)


def search_filter(namespace: str | None = None, collection: str | None = None, trust: list[str] | None = None, status: list[str] | None = None, prefix: str | None = None) -> Column:
    """The candidates' predicate; None means unrestricted and an empty list is an error."""
    ok = F.lit(True)
    for column, value in (("namespace", namespace), ("collection", collection)):
        if value is not None:
            ok &= F.col(column) == value
    for column, values in (("trust", trust), ("status", status)):
        if values is not None:
            if not values:
                raise ValueError(f"an empty set of {column} allows nothing")
            ok &= F.col(column).isin(*values)
    return ok & F.col("path").startswith(prefix) if prefix else ok


def served(status: list[str] | None, include_candidate: bool) -> list[str] | None:
    """The statuses to serve: those asked for, without candidates unless they are allowed; [] serves nothing."""
    allowed = ["verified", "evidence", "candidate"] if include_candidate else ["verified", "evidence"]
    if status is None:
        return None if include_candidate else allowed
    return [s for s in status if s in allowed]


def snippet(text: Column, mode: str = "snippet", size: int = 320) -> Column:
    if mode == "none":
        return F.lit("")
    if mode == "full":
        return text
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size - 3)), F.lit("..."))).otherwise(text)


def pack(hits: DataFrame, budget: int) -> DataFrame:
    """query_id, kept, omitted, spent, exceeded: the ranked anchors that fit the budget; one that doesn't fit is skipped,
    not the end. Where the first hit alone is over the budget, exceeded is true and nothing is kept.

    hits: query_id, rank, anchor, tokens. A query's hits are bounded by its limit.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anchor", F.col("tokens").cast("long").alias("tokens")))).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("omitted"))

    def step(s: Column, x: Column) -> Column:
        fits = s["spent"] + x["tokens"] <= budget
        name = F.array(x["anchor"])
        return F.struct(
            F.when(fits, s["spent"] + x["tokens"]).otherwise(s["spent"]).alias("spent"),
            F.when(fits, F.concat(s["kept"], name)).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["omitted"]).otherwise(F.concat(s["omitted"], name)).alias("omitted"),
        )

    packed = listed.select("query_id", F.aggregate("hits", start, step).alias("p"), (F.element_at("hits", 1)["tokens"] > budget).alias("exceeded"), F.transform("hits", lambda x: x["anchor"]).alias("every"))
    none = F.array().cast("array<string>")
    return packed.select("query_id", F.when(F.col("exceeded"), none).otherwise(F.col("p.kept")).alias("kept"), F.when(F.col("exceeded"), F.col("every")).otherwise(F.col("p.omitted")).alias("omitted"), F.when(F.col("exceeded"), 0).otherwise(F.col("p.spent")).cast("long").alias("spent"), "exceeded")


# Re-rankers: each takes hits (query_id, anchor, doc, score, rank) and gives new ranks.


def reranked(hits: DataFrame, *order: Column, limit: int = 10) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.drop("rank").withColumn("rank", place).filter(F.col("rank") <= limit)


def document_cap(hits: DataFrame, cap: int, limit: int = 10) -> DataFrame:
    """At most cap hits of a document; the places this frees are filled from below."""
    within = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank"))
    return reranked(hits.withColumn("_old", F.col("rank")).withColumn("_n", within).filter(F.col("_n") <= cap), F.col("_old"), limit=limit).drop("_n", "_old")


def document_decay(hits: DataFrame, decay: float, limit: int = 10) -> DataFrame:
    """Each further hit of a document counts decay times the one before."""
    within = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank"))
    paid = hits.withColumn("_old", F.col("rank")).withColumn("score", F.round(F.col("score") * F.pow(F.lit(decay), within - 1), 6))
    return reranked(paid, F.desc("score"), F.col("_old"), limit=limit).drop("_old")


def length_prior(hits: DataFrame, floor: int, limit: int = 10) -> DataFrame:
    """Passages shorter than floor tokens count in proportion."""
    prior = F.least(F.lit(1.0), F.col("tokens") / F.lit(float(floor)))
    return reranked(hits.withColumn("score", F.round(F.col("score") * prior, 6)), F.desc("score"), F.col("anchor"), limit=limit)


def section_best(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The best hit of each section stands for it."""
    best = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "anchor"))
    return reranked(hits.withColumn("_n", best).filter("_n = 1").drop("_n"), F.desc("score"), F.col("anchor"), limit=limit)


def depth_boost(hits: DataFrame, weight: float, limit: int = 10, within: bool = False) -> DataFrame:
    """Each level of heading below the first counts weight times more; old ranks break ties. hits: also depth.
    within: only the first ``limit`` change places."""
    pool = hits.filter(F.col("rank") <= limit) if within else hits
    boosted = pool.withColumn("_old", F.col("rank")).withColumn("score", F.round(F.col("score") * F.pow(F.lit(weight), F.greatest(F.col("depth") - 1, F.lit(0))), 6))
    return reranked(boosted, F.desc("score"), F.col("_old"), limit=limit).drop("_old")


def shuffled_boost(hits: DataFrame, weight: float, limit: int = 10) -> DataFrame:
    """The control of depth_boost: the same depths, dealt to other hits of the query in an order seeded by its id."""
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy("rank"))
    dealt = hits.select("query_id", "depth", F.row_number().over(w.orderBy(F.sha2(F.concat_ws("/", F.col("query_id").cast("string"), "anchor"), 256))).alias("_k"))
    return depth_boost(hits.drop("depth").withColumn("_k", place).join(dealt, ["query_id", "_k"]).drop("_k"), weight, limit)


def coverage_first(hits: DataFrame, limit: int = 10) -> DataFrame:
    """By distinct query terms held, then score, then anchor. hits: also distinct_terms."""
    return reranked(hits, F.desc("distinct_terms"), F.desc("score"), F.col("anchor"), limit=limit)


def grep_formula(hits: DataFrame, limit: int = 10) -> DataFrame:
    """By distinct query terms held, then all occurrences, then anchor. hits: also distinct_terms, occurrences."""
    return reranked(hits, F.desc("distinct_terms"), F.desc("occurrences"), F.col("anchor"), limit=limit)


def section_order(hits: DataFrame, sections: DataFrame, limit: int = 10) -> DataFrame:
    """Whole sections by their own rank, unranked ones last by their best hit; inside, by score. hits: also section;
    sections: query_id, section, rank."""
    best = F.max("score").over(Window.partitionBy("query_id", "section"))
    placed = hits.join(sections.withColumnRenamed("rank", "_s"), ["query_id", "section"], "left").withColumn("_best", best)
    return reranked(placed, F.col("_s").asc_nulls_last(), F.desc("_best"), F.col("section"), F.desc("score"), F.col("anchor"), limit=limit).drop("_s", "_best")


def section_fused(hits: DataFrame, sections: DataFrame, limit: int = 10) -> DataFrame:
    """Fusion of the chunks' ranking with that of their sections' openers. sections: query_id, section, rank."""
    openers = sections.select("query_id", F.lit("section").alias("leg"), F.concat("section", F.lit("0")).alias("anchor"), "rank")
    return rrf(hits.select("query_id", F.lit("chunk").alias("leg"), "anchor", "rank").unionByName(openers), limit)


def open_if_candidate(hits: DataFrame, limit: int = 10) -> DataFrame:
    """Each section once, where its first hit stands: by its opening chunk if that is a hit too. hits: also section."""
    first = F.row_number().over(Window.partitionBy("query_id", "section").orderBy("rank"))
    opener = hits.select("query_id", F.col("anchor").alias("_opener"))
    placed = hits.withColumn("_n", first).filter("_n = 1").withColumn("_opener", F.concat("section", F.lit("0")))
    placed = placed.join(opener.withColumn("_is", F.lit(True)), ["query_id", "_opener"], "left").withColumn("anchor", F.when(F.col("_is"), F.col("_opener")).otherwise(F.col("anchor")))
    return reranked(placed.withColumn("_old", F.col("rank")), F.col("_old"), limit=limit).drop("_n", "_opener", "_is", "_old")


def oracle_ceiling(arms: DataFrame, judged: DataFrame) -> DataFrame:
    """case_id, best, perfect: the best score of any arm on each case, and that of the best order its pool allows.
    arms: case_id, arm, ndcg; judged: case_id, perfect."""
    return arms.groupBy("case_id").agg(F.max("ndcg").alias("best")).join(judged, "case_id", "left")


def redundancy(hits: DataFrame, overlap: float = 0.8, depth: int = 10) -> DataFrame:
    """cases, duplicate_slots, overlapping_pairs, adjacent_slots and the cases with each: one row. hits: query_id, anchor,
    rank, digest, tokens (an array), section, position. The hits of one query are at most ``depth``, so pairs are few."""
    served = hits.filter(F.col("rank") <= depth)
    a = served.select("query_id", F.col("rank").alias("r1"), F.col("digest").alias("d1"), F.array_distinct("tokens").alias("t1"))
    b = served.select("query_id", F.col("rank").alias("r2"), F.col("digest").alias("d2"), F.array_distinct("tokens").alias("t2"))
    union = F.size(F.array_union("t1", "t2"))
    pairs = a.join(b, "query_id").filter("r1 < r2 and d1 <> d2").filter((union > 0) & (F.size(F.array_intersect("t1", "t2")) >= overlap * union))
    same = served.groupBy("query_id", "digest").agg((F.count("*") - 1).alias("n")).groupBy("query_id").agg(F.sum("n").alias("duplicate"))
    step = F.col("position") - F.lag("position").over(Window.partitionBy("query_id", "section").orderBy("position"))
    near = served.filter("position >= 0").withColumn("_s", step).groupBy("query_id").agg(F.count_if(F.col("_s") == 1).alias("adjacent"))
    by = served.select("query_id").distinct().join(same, "query_id", "left").join(pairs.groupBy("query_id").agg(F.count("*").alias("overlapping")), "query_id", "left").join(near, "query_id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(F.count("*").alias("cases"), n("duplicate").alias("duplicate_slots"), n("overlapping").alias("overlapping_pairs"), n("adjacent").alias("adjacent_slots"), F.count_if(F.col("duplicate") > 0).alias("with_duplicate"), F.count_if(F.col("overlapping") > 0).alias("with_overlap"), F.count_if(F.col("adjacent") > 0).alias("with_adjacent"))
