"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the total by its weight, but at most ``epochs`` times its own size; what a source
cannot take is shared again among the others by weight until none is above its limit. The shares that this
repetition ends in are min(weight * level, limit) for one water level, which is found by sorting the sources by
limit / weight. A source's target over its size is then a number of repetitions: every document is taken the whole
number of times, and the documents that come first in a seeded order once more, until the source's words are
nearest to the target.

The seeded order is cut without gathering a source in one task: sizes are summed in ``buckets`` parts of the
order, the part that holds the cut is found from those sums, and only its documents are sorted.

Defined results: a null text has size 0 and is taken like others of its source. A null source is a source of its
own and comes last. Rows that repeat a doc_id are documents of their own. A source of size 0 has target 0. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import WORD, id_key, materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target.

    The sources are one row each, whatever the number of documents; only their running sums are ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    w = w.withColumn("fills_at", F.col("limit") / F.col("weight"))
    every, filled = Window.partitionBy(), Window.orderBy("fills_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    # the level if the sources before this one are full and the others, from this one on, are not
    w = w.withColumn("level", (total - before("limit")) / (all_weight - before("weight")))
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(every)
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * level, F.col("limit")))
    return w.select("source", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """Never null, so that a null source joins like any other."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 17, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). rows: doc_id, skey, size, ord for each document. cuts: for each source its sizes, its target,
    the whole repetitions and the place in the seeded order up to which documents are taken once more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), seeded(id_col, text_col, seed).alias("ord"))
    rows = materialize(rows.withColumn("skey", source_key(F.col("source"))), "mix-rows")
    part = part_of("ord", F.lit(buckets))
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = shares.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    shares = shares.select(source_key(F.col("source")).alias("skey"), "source_size", "target", "whole", "rest")
    parts = rows.groupBy("skey", part.alias("part")).agg(F.sum("size").alias("part_size"))
    up_to = F.sum("part_size").over(Window.partitionBy("skey").orderBy("part"))  # at most `buckets` rows a source
    parts = parts.withColumn("before", up_to - F.col("part_size")).join(shares, "skey")
    # the whole parts that lie before the cut, and the part that holds it
    edge = parts.filter("before < rest").groupBy("skey").agg(F.max(F.struct("part", "before", "rest")).alias("edge")).select("skey", "edge.*")
    inside = rows.withColumn("part", part).join(edge, ["skey", "part"])
    running = F.sum("size").over(Window.partitionBy("skey").orderBy("ord", id_key("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("more", F.col("before") + running - F.col("size") / 2.0 <= F.col("rest"))
    last = inside.filter("more").groupBy("skey").agg(F.max(F.struct("ord", id_key("doc_id").alias("id"))).alias("last"))
    cuts = shares.join(edge.select("skey", "part"), "skey", "left").join(last, "skey", "left")
    return rows, materialize(cuts.select("skey", "source_size", "target", "whole", F.col("part").alias("cut_part"), F.col("last.ord").alias("cut_ord"), F.col("last.id").alias("cut_id"), F.lit(buckets).alias("buckets"), F.lit(epochs).alias("epochs")), "mix-cuts")


def seeded(id_col: str, text_col: str, seed: int) -> Column:
    """The place of a row in the seeded order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).cast("binary"))


def part_of(ord_col: str, buckets: Column) -> Column:
    """Which of the equal parts of the seeded order a place lies in, by its first seven digits."""
    return F.floor(F.conv(F.substring(ord_col, 1, 7), 16, 10).cast("long") * buckets / F.lit(float(1 << 28))).cast("int")


def copies(ord_col: str = "ord", id_col: str = "doc_id") -> Column:
    """How often a row joined with its source's cut is taken."""
    part = part_of(ord_col, F.col("buckets"))
    upto = (F.col(ord_col) < F.col("cut_ord")) | ((F.col(ord_col) == F.col("cut_ord")) & (id_key(id_col) <= F.col("cut_id")))
    more = F.when(part < F.col("cut_part"), True).when(part == F.col("cut_part"), F.coalesce(upto, F.lit(False))).otherwise(False)
    return F.least(F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"), F.col("epochs").cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row for each row of docs.

    The cuts are one row a source in a written table; Spark broadcasts it where its size is below the session's
    threshold, and otherwise joins with skewed partitions split.
    """
    rows, cuts = plan(docs, **how)
    out = rows.join(cuts, "skey").withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeat(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    _, cuts = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, own, strict=True))
    row = docs.toDF(*own).withColumn("skey", source_key(F.col(named[source_col]).cast("string"))).withColumn("ord", seeded(named[id_col], named[text_col], seed))
    taken = row.join(cuts, "skey").withColumn("copies", copies("ord", named[id_col])).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*own).toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
