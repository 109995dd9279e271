"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 values (seed 42) of the
document's three-word shingles. Fingerprints link at RADIUS (2) or fewer differing bits; a document's component
is the smallest doc_id that links reach.

Linking works on distinct fingerprints, which are cut into CUTS (6) segments around a ring. Two bits touch two segments
at most, so a pair within the radius agrees in four, and any four of six have neighbours. A key is four segments, about
43 bits, so that keys stay rare however many fingerprints there are: of 2**40 at random, one in eight shares a given
key with another. By the pigeonring principle some chain of consecutive segments of such a pair has
cumulative differences within the proportional budgets RADIUS * length / CUTS (0, 0, 1, 1, 1), and candidates without
such a chain are pruned before the full Hamming check.

A key that over ``pairs_up_to`` fingerprints share isn't paired, so that a crowd of any size costs a multiple of its size:
what differs there lies in the key's free bits, so each fingerprint is listed under itself and under each fingerprint
that one free bit makes of it. Those that meet in a list are within two bits, lists have at most 65 members, and no
link is lost.

Components come from alternating large-star and small-star steps on the edges, all of them joins and groupings.

Defined results: a null or empty text, or one without words, has fingerprint zero, linked like any other; fewer than
three words are one shingle. Rows that repeat a doc_id get a row each. Null doc_ids are never the smallest; a
component without any other has a null component_id. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from loomdex.llm.common import arrow_map, as_bytes, batch, id_key, materialize, remove, settled, store

SEED = 42
WORDS = 3
RADIUS = 2
CUTS = 6


def hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The hash of each run of so many words, in order, repeats included."""
    w = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, max(1, len(w) - words + 1))


def majority(h: np.ndarray) -> int:
    """The 64 bits, as a signed long, that are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    return majority(hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, version: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): a row for each row of docs; version: also a hash of the text."""
    fields = [("doc_id", pa.int64()), ("fp", pa.int64())] + [("version", pa.int64())] * version
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [fingerprint(t or b"", words) for t in as_bytes(b.column(1))], *b.columns[2:])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *[F.xxhash64(text_col)] * version)
    return rows.transform(arrow_map, run, ", ".join(f"{n} long" for n, _ in fields))


def segments(cuts: int = CUTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    ends = [round(64 * k / cuts) for k in range(cuts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def mask(at: int, width: int) -> int:
    return signed(((1 << width) - 1) << at)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chained(diff: Column, parts: list[tuple[int, int]]) -> Column:
    """Whether around the ring of segments some chain begins whose cumulative differences stay within RADIUS * length /
    segments at each length."""
    m, found = len(parts), F.lit(False)
    for start in range(m):
        within, covered = F.lit(True), 0
        for length in range(1, m):  # the whole ring is the Hamming distance itself
            covered |= mask(*parts[(start + length - 1) % m])
            within &= F.bit_count(diff.bitwiseAND(F.lit(covered))) <= RADIUS * length // m
        found |= within
    return found


def edges(fps: DataFrame, cuts: int = CUTS, pairs_up_to: int = 64) -> DataFrame:
    """f, g: links between distinct fingerprints that join all that are within RADIUS. fps: fp, distinct."""
    parts = segments(cuts)
    choices = list(itertools.combinations(range(cuts), cuts - RADIUS))  # the segments that agree
    covers = [functools.reduce(operator.or_, (mask(*parts[i]) for i in c)) for c in choices]
    free = [[0] + [mask(j, 1) for j in range(64) if not cover >> j & 1] for cover in covers]
    keys = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(c)).alias("val")) for i, c in enumerate(covers)])
    listed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.*").repartition("seg", "val")  # moved once for all
    sizes = listed.groupBy("seg", "val").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(listed.join(sizes, ["seg", "val"]), "shared-segments")
    paired = shared.filter(F.col("n") <= pairs_up_to)
    a, b = paired.select("seg", "val", F.col("fp").alias("f")), paired.select("seg", "val", F.col("fp").alias("g"))
    diff = F.col("f").bitwiseXOR(F.col("g"))
    near = a.join(b, ["seg", "val"]).filter(F.col("f") > F.col("g")).filter(chained(diff, parts)).filter(F.bit_count(diff) <= RADIUS).select("f", "g")
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in some]) for some in free]), F.col("seg") + 1)
    lists = shared.filter(F.col("n") > pairs_up_to).select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key")).distinct()
    first = F.min("fp").over(Window.partitionBy("key"))  # at most 65 fingerprints lie within one bit of a key
    starred = lists.withColumn("g", first).filter("fp <> g").select(F.col("fp").alias("f"), "g")
    return near.union(starred).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of links (f, g).

    A round makes each node's larger neighbours, then its smaller ones, children of its smallest neighbour. It ends
    when a round changes nothing. Only the number of edges and a checksum reach the driver.
    """
    spark = links.sparkSession

    def state(at: str) -> tuple:
        r = spark.read.schema("f long, g long").parquet(at).agg(F.count("*"), F.sum(F.xxhash64("f", "g").cast("decimal(38,0)"))).first()
        return tuple(r)

    path = store(links.select(F.greatest("f", "g").alias("f"), F.least("f", "g").alias("g")).filter("f <> g").distinct(), "links")
    was = state(path)
    while was[0]:
        e = spark.read.schema("f long, g long").parquet(path)
        both = e.union(e.select(F.col("g").alias("f"), F.col("f").alias("g")))
        least = both.groupBy("f").agg(F.min("g").alias("m")).select("f", F.least("f", "m").alias("m"))
        large = both.join(least, "f").filter("g > f").select(F.col("g").alias("f"), F.col("m").alias("g")).filter("f <> g").distinct()
        least = large.groupBy("f").agg(F.min("g").alias("m"))
        small = large.join(least, "f")
        small = small.filter("g <> m").select(F.col("g").alias("f"), F.col("m").alias("g")).union(least.select("f", F.col("m").alias("g"))).distinct()
        new = store(small, "links")
        remove(spark, path)
        path, before, was = new, was, state(new)
        if was == before:
            break
    e = spark.read.schema("f long, g long").parquet(path)
    return e.select(F.col("f").alias("node"), F.col("g").alias("root"))


def linked(rows: DataFrame) -> DataFrame:
    """fp, root, component_id for each distinct fp of rows (doc_id, fp)."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(edges(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id: a row for each row of docs."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return rows.join(settled(lambda: linked(rows), "classes"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one row of each component: that with the smallest id, then the smallest hash of its text."""
    names, own = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    i, t = own[names.index(id_col)], own[names.index(text_col)]
    row = docs.toDF(*own).withColumn("_id", id_key(i)).withColumn("_version", F.xxhash64(t))
    keyed = docs.toDF(*own).select(F.col(i).alias("doc_id"), F.col(t).alias("text"))
    rows = materialize(fingerprints(keyed, "doc_id", "text", words, version=True), "fingerprints")
    kept = rows.join(settled(lambda: linked(rows), "classes").select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(id_key("doc_id").alias("_id"), F.col("version").alias("_version"))).alias("k")).select("k.*")
    rest = [F.col(c) for c, f in zip(own, docs.schema, strict=True) if c not in (i, t) and isinstance(f.dataType, AtomicType)]
    place = F.row_number().over(Window.partitionBy("_id", "_version").orderBy(F.col(t), *rest))  # of rows that repeat
    return row.join(kept, ["_id", "_version"], "left_semi").withColumn("_place", place).filter("_place = 1").select(*own).toDF(*names)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
