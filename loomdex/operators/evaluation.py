"""Retrieval evaluation: credit, metrics, slices, gates and significance, all over tables."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import percentile
from loomdex.functions.work import written


def credited(results: DataFrame, judged: DataFrame) -> DataFrame:
    """case_id, rank, anchor, grade: each judgement counts once, for the first result that meets it.

    results: case_id, rank, anchor; judged: case_id, anchor, grade. A judgement is a chunk's anchor or a section's,
    which ends with /. A result that has a chunk's credit doesn't use up its section's.
    """
    once = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    j = judged.select("case_id", F.col("anchor").alias("target"), "grade")
    chunk = results.join(j, (results["case_id"] == j["case_id"]) & (results["anchor"] == j["target"])).select(results["case_id"], "rank", "anchor", "target", "grade")
    chunk = chunk.withColumn("_n", once("case_id", "target")).filter("_n = 1")
    left = results.join(chunk.select("case_id", "rank"), ["case_id", "rank"], "left_anti").withColumn("section", F.regexp_replace("anchor", "[^/]*$", ""))
    section = left.join(j.filter(F.col("target").endswith("/")), (left["case_id"] == j["case_id"]) & (left["section"] == j["target"])).select(left["case_id"], "rank", "anchor", "target", "grade")
    section = section.withColumn("_n", once("case_id", "target")).filter("_n = 1")
    return chunk.unionByName(section).drop("_n")


def metrics(results: DataFrame, judged: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """case_id, ndcg, recall, rr for each answerable case: exponential gain, logarithmic discount."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    got = credited(results, judged).filter(F.col("rank") <= k)
    dcg = got.groupBy("case_id").agg(F.sum(F.round(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0), 9).cast("decimal(20,9)")).alias("dcg"), F.count("*").alias("hits"), F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "anchor"))
    best = judged.withColumn("p", place)
    ideal = best.groupBy("case_id").agg(F.sum(F.when(F.col("p") <= k, F.round(gain(F.col("grade")) / F.log2(F.col("p") + 1.0), 9).cast("decimal(20,9)"))).alias("ideal"), F.count("*").alias("n"))
    rows = cases.filter("answerable").join(ideal, "case_id", "left").join(dcg, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "case_id",
        F.round(zero(F.col("dcg").cast("double") / F.col("ideal").cast("double")), 6).alias("ndcg"),
        F.round(zero(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(zero(1.0 / F.col("first")), 6).alias("rr"),
    )


def in_slices(cases: DataFrame, slices: DataFrame | None) -> DataFrame:
    """cases with slice: a row of each for ALL and for each of its slices. Cases are computed once, however they come about."""
    everywhere = F.array(F.lit("ALL"))
    if slices is None:
        return cases.withColumn("slice", F.explode(everywhere))
    own = slices.groupBy("case_id").agg(F.collect_list("slice").alias("_own"))
    return cases.join(own, "case_id", "left").withColumn("slice", F.explode(F.concat(everywhere, F.coalesce("_own", F.array().cast("array<string>"))))).drop("_own")


def summary(case_metrics: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """slice, cases and the mean of each metric; slices: case_id, slice (a case may be in several); ALL is every case."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 6).alias(c)
    return in_slices(case_metrics, slices).groupBy("slice").agg(F.count("*").alias("cases"), *[mean(c) for c in ("ndcg", "recall", "rr")])


def latency(times: DataFrame, group: str, value: str, parts: int = 1024) -> DataFrame:
    """group, n, p50, p95: the elements at half-even rounded places of each group's sorted values.

    Values are counted by equal ranges first; only those of the range that holds a place are ranked, so a group of any
    size doesn't meet in one task unless its values are equal, and then no ranking is needed to know them.
    """
    rows = times.select(group, F.col(value).cast("double").alias("_v"), F.col(value).alias("_w")).filter("_v is not null and not isnan(_v)")
    by = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    placed = rows.join(by, group).withColumn("_p", F.least(F.floor(share * parts), F.lit(parts - 1)))
    counts = placed.groupBy(group, "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of at most `parts` rows
    spots = by.select(group, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.bround(F.lit(f) * (F.col("n") - 1)).cast("long").alias("_at")) for name, f in (("p50", 0.5), ("p95", 0.95))])).alias("s")).select(group, "n", "s.*")
    where = spots.join(counts.withColumn("_b", before), group).filter((F.col("_at") >= F.col("_b")) & (F.col("_at") < F.col("_b") + F.col("_c"))).select(group, "n", "_name", (F.col("_at") - F.col("_b")).alias("_k"), "_p")
    # equal values count once, with how often they occur; a running count finds the place among them
    inside = placed.join(where, [group, "_p"]).groupBy(group, "_name", "_k", "_w").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group, "_name").orderBy("_w"))
    hit = inside.withColumn("_u", upto).filter((F.col("_u") > F.col("_k")) & (F.col("_u") - F.col("_c") <= F.col("_k")))
    got = hit.groupBy(group).agg(*[F.max(F.when(F.col("_name") == name, F.col("_w"))).alias(name) for name in ("p50", "p95")])
    return by.select(group, "n").join(got, group)


def needed_cases(scores: DataFrame, group: str, value: str, drop: float = 0.02, fallback: int = 4) -> DataFrame:
    """group, n, needed, armed: a slice's gate is armed with at least ceil(upper median of its non-zero scores /
    (drop * its mean)) cases. Equal scores are counted, not gathered."""
    by = scores.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("decimal(18,6)")).cast("double").alias("mean"), F.count_if(F.col(value) > 0).alias("some"))
    counted = scores.filter(F.col(value) > 0).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = counted.withColumn("_u", F.sum("_c").over(Window.partitionBy(group).orderBy("_v"))).join(by, group)
    upper = upto.filter((F.col("_u") > F.floor(F.col("some") / 2)) & (F.col("_u") - F.col("_c") <= F.floor(F.col("some") / 2))).select(group, F.col("_v").alias("upper"))
    needed = F.when((F.col("some") > 0) & (F.col("mean") > 0), F.ceil(F.col("upper") / (drop * F.col("mean")))).otherwise(F.lit(fallback)).cast("long")
    return by.join(upper, group, "left").withColumn("needed", needed).select(group, "n", "needed", (F.col("n") >= F.col("needed")).alias("armed"))


def regression_gate(ours: DataFrame, blessed: DataFrame, group: str, value: str, drop: float = 0.02) -> DataFrame:
    """group, ours, blessed, passed: a slice fails where its mean falls by over ``drop`` of the blessed mean."""
    mean = lambda df, name: df.groupBy(group).agg(F.round(F.avg(F.col(value).cast("decimal(18,6)")).cast("double"), 6).alias(name))
    both = mean(ours, "ours").join(mean(blessed, "blessed"), group)
    return both.withColumn("passed", F.col("ours") >= F.round(F.col("blessed") * (1 - drop), 6))


def upper_tail(m: int, w: int) -> float:
    """The chance of w or more heads in m tosses, to more digits than a double's. Terms are added from w away from the
    middle, each from the one before, in fixed point; about 20 * sqrt(m) of them count. Few tosses are counted in whole numbers."""
    if not m or w <= 0:
        return 1.0
    if m <= 1000:
        term, total = math.comb(m, w), 0
        for k in range(w, m + 1):
            total += term
            term = term * (m - k) // (k + 1)
        return total / 2**m
    if 2 * w <= m:
        return 1.0 - upper_tail(m, m - w + 1)
    with localcontext(prec=60):
        # Stirling's series; a factorial is taken at 50 or more, so that what is left out is below 1e-20 of it
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        series = (Decimal(1) / 12, Decimal(-1) / 360, Decimal(1) / 1260, Decimal(-1) / 1680, Decimal(1) / 1188, Decimal(-691) / 360360, Decimal(1) / 156)

        def log_factorial(n: int) -> Decimal:
            if n < 50:
                return Decimal(math.factorial(n)).ln()
            return (n + Decimal("0.5")) * Decimal(n).ln() - n + (2 * pi).ln() / 2 + sum(c / Decimal(n) ** (2 * i + 1) for i, c in enumerate(series))

        first = (log_factorial(m) - log_factorial(w) - log_factorial(m - w) - m * Decimal(2).ln()).exp()
        term, total, k = int(first * 2**160), 0, w
    while term:
        total += term
        term = term * (m - k) // (k + 1)
        k += 1
    return total / 2**160


def sign_test(pairs: DataFrame, group: str, ours: str, theirs: str) -> DataFrame:
    """group, wins, losses, p: the exact one-sided sign test."""
    n = pairs.groupBy(group).agg(F.count_if(F.col(ours) > F.col(theirs)).alias("wins"), F.count_if(F.col(ours) < F.col(theirs)).alias("losses"))

    @F.arrow_udf("double")
    def tail(wins, losses):
        import pyarrow as pa

        return pa.array([round(upper_tail(w + x, w), 9) for w, x in zip(wins.to_pylist(), losses.to_pylist(), strict=True)], pa.float64())

    return n.withColumn("p", tail("wins", "losses"))


def abstention(cases: DataFrame, answered: DataFrame, most: float = 0.05) -> DataFrame:
    """unanswerable, false_answers, rate, passed: one row. cases: case_id, answerable; answered: case_id."""
    rows = cases.filter("not answerable").join(answered.select("case_id").distinct().withColumn("_a", F.lit(1)), "case_id", "left")
    n = rows.agg(F.count("*").alias("unanswerable"), F.count("_a").alias("false_answers"))
    rate = F.when(F.col("unanswerable") > 0, F.round(F.col("false_answers") / F.col("unanswerable"), 6)).otherwise(F.lit(0.0))
    return n.withColumn("rate", rate).withColumn("passed", F.col("rate") <= most)


def coverage(claims: DataFrame) -> DataFrame:
    """doc_id, claims, cited, coverage: claims are blocks of five words or more (doc_id, text, cited)."""
    counted = claims.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 5)
    by = counted.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("cited")).alias("cited"))
    return by.withColumn("coverage", F.round(F.col("cited") / F.col("claims"), 6))


def p95_floor(values: Column) -> Column:
    return percentile(values, 0.95, floor=True)


# Citations, gates, incumbents and the judged set


def citation_metrics(results: DataFrame, chunks: DataFrame, cases: DataFrame, window: int = 10) -> DataFrame:
    """case_id, coverage, precision, cited_tokens, abstained of each case: the share of results that resolve, the share of
    the first ``window`` that lie under a heading, and what the resolving ones of those cost on average (half-even).

    results: case_id, rank, anchor; chunks: anchor, tokens, depth (headings above). No result: 1, 1, 0 and abstained.
    """
    rows = results.join(chunks.select("anchor", "tokens", "depth"), "anchor", "left").withColumn("_in", F.col("rank") <= window)
    by = rows.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count("tokens").alias("r"), F.count_if("_in").alias("w"), F.count_if(F.col("_in") & (F.col("depth") > 0)).alias("l"), F.avg(F.when(F.col("_in"), F.col("tokens"))).alias("t")
    )
    share = lambda a, b: F.round(F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(F.lit(1.0)), 6)
    got = cases.select("case_id").join(by, "case_id", "left")
    return got.select("case_id", share(F.col("r"), F.col("n")).alias("coverage"), share(F.col("l"), F.col("w")).alias("precision"), F.coalesce(F.bround("t"), F.lit(0)).cast("long").alias("cited_tokens"), F.col("n").isNull().alias("abstained"))


def citation_summary(case_metrics: DataFrame) -> DataFrame:
    """coverage and precision over all cases, cited_tokens over those that cite any: one row."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 6).alias(c)
    return case_metrics.agg(mean("coverage"), mean("precision"), F.coalesce(F.bround(F.avg(F.when(F.col("cited_tokens") > 0, F.col("cited_tokens")))), F.lit(0)).cast("long").alias("cited_tokens"))


def gate_citations(case_metrics: DataFrame) -> DataFrame:
    """gate, value, passed: every result of every case resolves."""
    return citation_summary(case_metrics).select(F.lit("G1 Citations").alias("gate"), F.col("coverage").alias("value"), (F.col("coverage") == 1.0).alias("passed"))


def gate_hybrid(lexical: DataFrame, hybrid: DataFrame, slices: DataFrame, gain: float = 0.05, floor: float = -0.02) -> DataFrame:
    """lexical, hybrid, delta, regressions (slices), earns: one row. A challenger earns the default with ``gain`` more nDCG
    overall and no slice below ``floor``; the gate reports, it doesn't fail. lexical, hybrid: case_id, ndcg; slices: case_id, slice."""
    mean = lambda c: F.avg(F.col(c).cast("decimal(18,6)")).cast("double")
    both = lexical.select("case_id", F.col("ndcg").alias("l")).join(hybrid.select("case_id", F.col("ndcg").alias("h")), "case_id")
    delta = F.when(F.col("lexical") > 0, F.col("hybrid") / F.col("lexical") - 1).otherwise(F.lit(0.0))
    worse = both.join(slices, "case_id").groupBy("slice").agg(mean("l").alias("lexical"), mean("h").alias("hybrid")).filter(delta < floor).agg(F.array_sort(F.collect_list("slice")).alias("regressions"))
    row = both.agg(mean("l").alias("lexical"), mean("h").alias("hybrid")).withColumn("delta", F.round(delta, 6)).crossJoin(worse)  # one row each
    return row.select(F.round("lexical", 6).alias("lexical"), F.round("hybrid", 6).alias("hybrid"), "delta", "regressions", ((F.col("delta") >= gain) & (F.size("regressions") == 0)).alias("earns"))


def gate_regression(ours: DataFrame, blessed: DataFrame, slices: DataFrame, same_corpus: bool = True, same_cases: bool = True, drop: float = 0.02, reported: tuple[str, ...] = ("unanswerable",)) -> DataFrame:
    """slice, ours, blessed, delta, armed, moved, passed: a slice fails where its mean falls by over ``drop`` of the blessed
    mean, it has cases enough for that to mean more than one of them, and corpus and cases are those that were blessed.

    ours, blessed: case_id, ndcg; slices: case_id, slice. Slices in ``reported`` and those blessed at zero are never armed.
    """
    mean = F.avg(F.col("ndcg").cast("decimal(18,6)")).cast("double")
    now = ours.join(slices, "case_id").groupBy("slice").agg(F.round(mean, 6).alias("ours"), F.count("*").alias("_n"))
    before = blessed.join(slices, "case_id")
    needed = needed_cases(before, "slice", "ndcg", drop).select("slice", "needed")
    both = now.join(before.groupBy("slice").agg(F.round(mean, 6).alias("blessed")), "slice").join(needed, "slice")
    delta = F.when(F.col("blessed") > 0, F.round(F.col("ours") / F.col("blessed") - 1, 6)).otherwise(F.lit(0.0))
    armed = (F.col("_n") >= F.col("needed")) & (F.col("blessed") > 0) & ~F.col("slice").isin(*reported)
    both = both.withColumn("delta", delta).withColumn("armed", armed).withColumn("moved", F.col("delta") < -drop)
    return both.select("slice", "ours", "blessed", "delta", "armed", "moved", (~(F.col("armed") & F.col("moved")) | F.lit(not (same_corpus and same_cases))).alias("passed"))


def gate_latency(times: DataFrame, value: str, budget: float = 150.0) -> DataFrame:
    """gate, p50, p95, passed: the 95th percentile of the times is within the budget."""
    got = latency(times.withColumn("_g", F.lit(1)), "_g", value)
    return got.select(F.lit("G5 Performance").alias("gate"), "p50", "p95", (F.col("p95") <= budget).alias("passed"))


def gate_determinism(one: DataFrame, other: DataFrame) -> DataFrame:
    """gate, differing, passed: two builds' digests (name, digest) agree, and neither has one the other lacks."""
    both = one.select("name", F.col("digest").alias("a")).join(other.select("name", F.col("digest").alias("b")), "name", "full_outer")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")).select(F.lit("G6 Determinism").alias("gate"), "differing", (F.col("differing") == 0).alias("passed"))


def incumbent(ours: DataFrame, theirs: DataFrame, slices: DataFrame) -> DataFrame:
    """slice, ours, theirs, lead, conceded: means by slice, ALL first; a slice is conceded where theirs is higher. Both:
    case_id, ndcg; slices: case_id, slice."""
    both = ours.select("case_id", F.col("ndcg").alias("o")).join(theirs.select("case_id", F.col("ndcg").alias("t")), "case_id")
    rows = in_slices(both, slices)
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 6)
    by = rows.groupBy("slice").agg(mean("o").alias("ours"), mean("t").alias("theirs"))
    return by.withColumn("lead", F.round(F.col("ours") - F.col("theirs"), 6)).withColumn("conceded", F.col("theirs") > F.col("ours"))


def losses(ours: DataFrame, theirs: DataFrame, slices: DataFrame) -> DataFrame:
    """slice, case_id, ours, theirs, gap, place: the cases that lose in each conceded slice, worst first."""
    ours, theirs = written(ours.select("case_id", "ndcg"), "ours"), written(theirs.select("case_id", "ndcg"), "theirs")  # each is asked twice
    conceded = incumbent(ours, theirs, slices).filter("conceded and slice <> 'ALL'").select("slice")
    both = ours.select("case_id", F.col("ndcg").alias("ours")).join(theirs.select("case_id", F.col("ndcg").alias("theirs")), "case_id").filter("theirs > ours")
    rows = both.join(slices.join(conceded, "slice", "left_semi"), "case_id").withColumn("gap", F.round(F.col("ours") - F.col("theirs"), 6))
    return rows.select("slice", "case_id", "ours", "theirs", "gap", F.row_number().over(Window.partitionBy("slice").orderBy("gap", "case_id")).alias("place"))


def evenly(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows evenly spaced in the order of key: those at int(i * n / size); all, if there are no more. Rows are
    sorted in ranges of key; a range's rows are numbered in it, and from the counts of the ranges before it."""
    dealt = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(dealt, "in-order").withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_c"))  # a row for each partition
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_c").over(Window.partitionBy())
    placed = dealt.join(F.broadcast(counts.select("_range", before.alias("_b"), total.alias("_n"))), "_range").withColumn("_k", F.col("_b") + F.col("_at"))
    i = f"((_k * {size}L + _n - 1L) div _n)"  # the first i whose place is not before this row, in whole numbers
    hit = F.expr(f"{i} < {size}L and ({i} * _n) div {size}L = _k")
    return placed.filter((F.col("_n") <= size) | hit).drop("_n", "_k", "_b", "_at", "_range", "_id", "_c")


def validate(cases: DataFrame, judged: DataFrame, chunks: DataFrame, answered: DataFrame, stub: int = 30) -> DataFrame:
    """case_id, level, problem, anchor: what is wrong with a judged set: anchors and sections that aren't in the corpus,
    unanswerable cases that something answers, and (a warning) best judgements on chunks too short to carry an answer.

    cases: case_id, answerable; judged: case_id, anchor, grade; chunks: anchor, tokens; answered: case_id, anchor (the first result).
    """
    section = judged.filter(F.col("anchor").endswith("/"))
    chunk = judged.filter(~F.col("anchor").endswith("/"))
    gone = section.join(chunks.select(F.regexp_replace("anchor", "[^/]*$", "").alias("anchor")).distinct(), "anchor", "left_anti").select("case_id", F.lit("error").alias("level"), F.lit("no such section").alias("problem"), "anchor")
    lost = chunk.join(chunks.select("anchor"), "anchor", "left_anti").select("case_id", F.lit("error").alias("level"), F.lit("no such chunk").alias("problem"), "anchor")
    stubs = chunk.filter("grade = 3").join(chunks.filter(F.col("tokens") < stub).select("anchor"), "anchor", "left_semi").select("case_id", F.lit("warning").alias("level"), F.lit("a heading without an answer").alias("problem"), "anchor")
    known = cases.filter("not answerable").select("case_id").join(answered, "case_id").select("case_id", F.lit("error").alias("level"), F.lit("unanswerable but answered").alias("problem"), "anchor")
    return gone.unionByName(lost).unionByName(stubs).unionByName(known)
