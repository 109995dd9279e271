"""Near-duplicates by Jaccard similarity of shingles, exact.

Two documents link if the sets of their five-word shingles (64-bit hashes) have a Jaccard similarity of 4/5 or more; a
component is all that links reach. SimHash comes first: a text's fingerprint is the majority of its shingles' hashes,
op5's pigeonring search pairs fingerprints that are equal or differ in 2 bits at most, and what it pairs is checked on
the whole sets. Fingerprints alone can't find all: at 4/5 about 10 of 64 bits differ, give or take 3, and segments for
such a radius are 3 bits wide. So what they leave apart is searched for pairs between their components.

These candidates come from prefix filtering, which loses no pair: in any one order of all shingles, sets of similarity t or
more meet within their first n - ceil(t * n) + 1. The order puts shingles that are common in a sample last; what the
sample holds changes how many candidates there are, never which links. The sets that have a shingle in front are a
group; groups of the same sets are one. A bitmap of each set travels to its groups, and there pairs fall out whose
bitmaps differ in more bits than similar sets do in members (a bitmap never differs in more bits than its set does in
members, so none is lost). Of the pairs left between components of the fingerprints, a forest that spans them is sent on, meets once more with bitmaps in
proportion to the sets, and is checked on the whole sets; where one of its edges fails, the group's other pairs between
components are checked too. Groups of more than ``most`` sets are searched by joins instead, to the same end.

Defined results: fewer than five words are one shingle; texts without words (or null) are copies of each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from loomdex.llm.common import arrow_map, as_bytes, batch, id_key, materialize, settled
from loomdex.llm.simhash import components, edges, hashes, majority

WORDS = 5
#: The most shingles that are put last, and in how many sampled documents (one of SAMPLE) they stand at least.
COMMON, COMMON_IN, SAMPLE = 65536, 5, 16
#: The bits of a set's bitmap.
BITS = 2048
#: The most members of a group that one task compares; larger ones are searched by joins.
GROUP = 2048


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the runs of so many words, ascending."""
    return np.unique(hashes(text, words))


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles, common ones last, of which two sets of similarity 4/5 share one."""
    n = len(s)
    if len(common) and n:
        last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~last], s[last]])
    return s[: n - (4 * n + 4) // 5 + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parity(s: np.ndarray, bits: int) -> bytes:
    """A bitmap of a set: each bit tells whether an odd number of members fall on it, so that two bitmaps differ in no
    more bits than their sets do in members."""
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def sketch(s: np.ndarray) -> bytes | None:
    """For a set too large for the bitmap that travels to its groups, one of two bits or more for each member."""
    return parity(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > BITS else None


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that stand in several of the sampled texts, COMMON at most; docs: text, version."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in as_bytes(b.column(0)):
                yield batch(schema, shingles(t or b"").view(np.int64))

    drawn = docs.filter(F.pmod("version", F.lit(SAMPLE)) == 0).dropDuplicates(["version"]).select("text").transform(arrow_map, run, "key long")
    often = drawn.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "key").limit(COMMON)
    return np.sort(np.array([r.key for r in often.select("key").collect()], np.int64).view(np.uint64))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, version, fp (a hash of the set), sim (the fingerprint), n, bits (its bitmap), sketch, front (the prefix) of each of docs (doc_id, text, version)."""
    common = common_shingles(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64()), ("sim", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("sketch", pa.binary()), ("front", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sim, n, bits, wide, front = [], [], [], [], [], []
            for t in as_bytes(b.column(2)):
                h = hashes(t or b"", WORDS)
                sim.append(majority(h))
                s = np.unique(h)
                fp.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                n.append(len(s))
                bits.append(parity(s, BITS))
                wide.append(sketch(s))
                front.append(prefix(s, common).tobytes())
            yield batch(schema, b.column(0), b.column(1), np.array(fp, np.uint64).view(np.int64), sim, n, bits, wide, front)

    return docs.select("doc_id", "version", "text").transform(arrow_map, run, "doc_id long, version long, fp long, sim long, n int, bits binary, sketch binary, front binary")


def fronts(classes: DataFrame) -> DataFrame:
    """key, fp, n for each shingle in front."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(2).to_pylist()
            counts = [len(x) // 8 for x in data]
            yield batch(schema, np.frombuffer(b"".join(data), np.int64), np.repeat(b.column(0).to_numpy(), counts), np.repeat(b.column(1).to_numpy(), counts))

    return classes.select("fp", "n", "front").transform(arrow_map, run, "key long, fp long, n int")


def _similar():
    @F.arrow_udf("boolean")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return check


def apart(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether bitmaps (rows of 64-bit words) tell that sets of na and nb members aren't similar: at 4/5, at most a
    ninth of both sizes isn't shared, and a bitmap differs in no more bits than its set does in members."""
    return 9 * np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) > na + nb


def grouped(rows: DataFrame, columns: list[str], each, schema: pa.Schema, sql: str) -> DataFrame:
    """each(key, columns as arrays) -> record columns or None, for each group of rows (key, fp, n, bits, ...) of one key,
    as the groups stream by in order of their keys; a task holds one group and one batch."""
    words = BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                new = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, words) if name == "bits" else b.column(k).to_numpy() for k, name in enumerate(columns)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not held or not len(held[0]):
                continue
            begins = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
            ends = np.append(begins[1:], len(held[0]))
            if b is not None:  # the last group may go on
                begins, ends = begins[:-1], ends[:-1]
            out = [got for x, y in zip(begins.tolist(), ends.tolist(), strict=True) if (got := each(*(c[x:y] for c in held))) is not None]
            if out:
                yield batch(schema, *(np.concatenate(x) for x in zip(*out, strict=True)))
            if len(ends):
                held = [c[ends[-1] :] for c in held]

    return rows.select(*columns).repartition("key").sortWithinPartitions("key", "fp").transform(arrow_map, run, sql)


EDGES = pa.schema([("key", pa.int64()), ("f", pa.int64()), ("g", pa.int64())])


def forest(members: DataFrame) -> DataFrame:
    """key, f, g: of the pairs of each group that its bitmaps leave open, a forest that spans them and joins the members of
    different roots, by searching breadth first; so copies of one text cost an edge each. members: key, fp, n, bits, root."""

    def each(key, fp, n, bits, root):
        left, found = np.arange(len(fp)), []
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                near = ~apart(bits[left], bits[x], n[left], n[x])
                near &= 5 * np.minimum(n[left], n[x]) >= 4 * np.maximum(n[left], n[x])
                same = root[left] == root[x]
                met = left[near & ~same]
                if len(met):
                    found.append(np.column_stack([np.full(len(met), x), met]))
                todo += left[near | same].tolist()
                left = left[~(near | same)]
        if not found:
            return None
        e = np.concatenate(found)
        return np.full(len(e), key[0]), fp[e].min(axis=1), fp[e].max(axis=1)

    return grouped(members, ["key", "fp", "n", "bits", "root"], each, EDGES, "key long, f long, g long")


def between(members: DataFrame) -> DataFrame:
    """key, f, g: of each group the pairs that its bitmaps leave open, between members of different roots."""

    def each(key, fp, n, bits, root):
        out = []
        for x in range(len(fp) - 1):
            rest = np.arange(x + 1, len(fp))
            rest = rest[(root[rest] != root[x]) & (5 * np.minimum(n[rest], n[x]) >= 4 * np.maximum(n[rest], n[x]))]
            rest = rest[~apart(bits[rest], bits[x], n[rest], n[x])]
            out.append(np.column_stack([np.full(len(rest), x), rest]))
        e = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return (np.full(len(e), key[0]), fp[e].min(axis=1), fp[e].max(axis=1)) if len(e) else None

    return grouped(members, ["key", "fp", "n", "bits", "root"], each, EDGES, "key long, f long, g long")


def _possible():
    @F.arrow_udf("boolean")
    def check(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in (a, b))
        return pa.array(~apart(x, y, na.to_numpy().astype(np.int64), nb.to_numpy().astype(np.int64)))

    return check


def possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (f, g) whose bitmaps leave it open whether they are similar; maps: fp, n, bits."""
    both = pairs.select("f", "g").join(maps.toDF("f", "_na", "_a"), "f").join(maps.toDF("g", "_nb", "_b"), "g")
    return materialize(both.filter(_possible()("_a", "_na", "_b", "_nb")).select("f", "g"), "possible")


def _alike():
    @F.arrow_udf("boolean")
    def check(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, nx, y, ny in zip(a.to_pylist(), na.to_pylist(), b.to_pylist(), nb.to_pylist(), strict=True):
            if x is None or y is None:
                out.append(True)
                continue
            x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            while len(y) > len(x):  # the sketch of half the bits
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            out.append(not apart(x, y, nx, ny))
        return pa.array(out, pa.bool_())

    return check


def alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (f, g) whose sketches leave it open whether they are similar; sets without a sketch do."""
    wide = rows.filter("sketch is not null").select("fp", "n", "sketch").dropDuplicates(["fp"])
    both = pairs.select("f", "g").join(wide.toDF("f", "_na", "_a"), "f", "left").join(wide.toDF("g", "_nb", "_b"), "g", "left")
    return both.filter(_alike()("_a", "_na", "_b", "_nb")).select("f", "g")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (f, g) that are similar; sets: fp, shingles."""
    both = pairs.select("f", "g").join(sets.toDF("f", "_a"), "f").join(sets.toDF("g", "_b"), "g")
    return both.filter(_similar()("_a", "_b")).select("f", "g")


def sized(a: str, b: str):
    """Whether sets of these sizes can be similar."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """f, g: pairs of sets, by fp, whose fingerprints are equal or near: the first set of a fingerprint with each other of
    it, and the first sets of two that op5's search links."""
    sims = rows.groupBy("fp").agg(F.min("sim").alias("sim"))
    firsts = materialize(sims.groupBy("sim").agg(F.min("fp").alias("first")), "fingerprints")
    equal = sims.join(firsts, "sim").filter("fp <> first").select(F.col("first").alias("f"), F.col("fp").alias("g"))
    near = edges(firsts.select(F.col("sim").alias("fp")))
    near = near.join(firsts.toDF("f", "_f"), "f").join(firsts.toDF("g", "_g"), "g").select(F.col("_f").alias("f"), F.col("_g").alias("g"))
    return equal.union(near).select(F.least("f", "g").alias("f"), F.greatest("f", "g").alias("g"))


def links(rows: DataFrame, texts: DataFrame, most: int = GROUP, rounds: int = 6) -> DataFrame:
    """f, g: links that join all similar sets; rows as from hashed, texts: doc_id, version, text."""
    pairs = materialize(alike(fingerprint_pairs(rows), rows), "fingerprint-pairs")
    first = materialize(checked(pairs, shingle_sets(rows, texts, ends(pairs))), "similar")
    dealt = fronts(rows.select("fp", "n", "front").dropDuplicates(["fp"])).repartition("key")  # moved once for both
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("held"), F.min("fp").alias("least")).filter("size > 1")
    listed = materialize(dealt.join(sizes, "key"), "fronts")
    # groups of the same members are one
    groups = listed.groupBy("size", "held", "least").agg(F.min("key").alias("key")).select("key")
    members = materialize(listed.join(groups, "key").select("key", "fp", "n", "size"), "front-groups")
    maps = rows.select("fp", "n", "bits").dropDuplicates(["fp"])
    few = members.filter(F.col("size") <= most).select("key", "fp").join(maps, "fp")
    few = few.join(components(first).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    trees = materialize(forest(few), "front-trees")
    crowded = members.filter(F.col("size") > most).select("key", "fp", "n")
    tried = trees.select("f", "g").distinct()
    left = materialize(alike(tried, rows), "alike")
    found = materialize(checked(left, shingle_sets(rows, texts, ends(left))), "similar").union(first)
    # where an edge of a tree fails, its group's other pairs decide
    torn = trees.join(found, ["f", "g"], "left_anti").select("key").distinct()
    roots = components(found).withColumnRenamed("node", "fp")
    open_ = few.drop("root").join(torn, "key", "left_semi").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    other = between(open_).select("f", "g").distinct().join(tried, ["f", "g"], "left_anti")
    other = materialize(alike(other, rows), "alike")
    found = found.union(checked(other, shingle_sets(rows, texts, ends(other))))
    return found if crowded.isEmpty() else found.union(crowd(crowded, rows, texts, rounds))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("f").alias("fp")).union(pairs.select("g")).distinct()


def shingle_sets(rows: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, shingles of each wanted fp, from one of the texts that have it."""
    first = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "version")).alias("k"))
    wanted = materialize(first.select("fp", F.col("k.doc_id").alias("doc_id"), F.col("k.version").alias("version")), "wanted")
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield batch(schema, part.column(0), [shingles(t or b"").tobytes() for t in as_bytes(part.column(1))])

    sets = texts.join(wanted, ["doc_id", "version"]).select("fp", "text").dropDuplicates(["fp"])
    return materialize(sets.transform(arrow_map, run, "fp long, shingles binary"), "shingle-sets")


def crowd(members: DataFrame, rows: DataFrame, texts: DataFrame, rounds: int) -> DataFrame:
    """f, g: links that join the similar sets of groups (key, fp, n) of any size, which are searched breadth first by
    joins: a pivot is compared with those not yet reached, and what it reaches are the next pivots; so copies of one
    text cost a round. What ``rounds`` rounds leave is paired."""
    sets, maps = shingle_sets(rows, texts, members.select("fp").distinct()), rows.select("fp", "n", "bits").dropDuplicates(["fp"])
    members, found = materialize(members.withColumn("reached", F.lit(False)), "crowds"), None
    for _ in range(rounds):
        if members.isEmpty():
            break
        pivots = members.groupBy("key").agg(F.min(F.struct((~F.col("reached")).alias("new"), "fp", "n")).alias("p")).select("key", F.col("p.fp").alias("g"), F.col("p.n").alias("ng"))
        held = members.join(pivots, "key").filter("fp <> g")
        asked = held.filter(~F.col("reached") & sized("n", "ng")).select(F.col("fp").alias("f"), "g").distinct()
        met = materialize(checked(alike(possible(asked, maps), rows), sets), "similar")
        found = met if found is None else found.union(met)
        held = held.join(met.select(F.col("f").alias("fp"), "g", F.lit(True).alias("_met")), ["fp", "g"], "left")
        held = held.select("key", "fp", "n", (F.col("reached") | F.coalesce("_met", F.lit(False))).alias("reached"))
        open_ = held.groupBy("key").agg(F.count("*").alias("size"), F.count_if(~F.col("reached")).alias("new")).filter("size > 1 and new > 0").select("key")
        members = materialize(held.join(open_, "key"), "crowds")
    left = members.select("key", F.col("fp").alias("f"), F.col("n").alias("nf"), F.col("reached").alias("rf"))
    left = left.join(members.select("key", F.col("fp").alias("g"), F.col("n").alias("ng"), F.col("reached").alias("rg")), "key")
    left = left.filter((F.col("f") < F.col("g")) & sized("nf", "ng") & ~(F.col("rf") & F.col("rg"))).select("f", "g").distinct()
    left = checked(alike(possible(left, maps), rows), sets)
    return left if found is None else found.union(left)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP, rounds: int = 6) -> DataFrame:
    """docs with one row of each component: that with the smallest id, then the smallest hash of its text."""
    names, own = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    i, t = own[names.index(id_col)], own[names.index(text_col)]
    row = docs.toDF(*own).withColumn("_id", id_key(i)).withColumn("_version", F.xxhash64(t))
    texts = row.select(F.col("_id").alias("doc_id"), F.col("_version").alias("version"), F.col(t).cast("string").alias("text"))

    def first() -> DataFrame:
        rows = materialize(hashed(texts), "shingles")
        roots = components(links(rows, texts, most, rounds)).withColumnRenamed("node", "fp")
        rooted = rows.select("doc_id", "version", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        return rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))).alias("k")).select("k.*")

    kept = settled(first, "kept")
    rest = [F.col(c) for c, f in zip(own, docs.schema, strict=True) if c not in (i, t) and isinstance(f.dataType, AtomicType)]
    place = F.row_number().over(Window.partitionBy("_id", "_version").orderBy(F.col(t), *rest))  # of rows that repeat
    return row.join(kept, ["_id", "_version"], "left_semi").withColumn("_place", place).filter("_place = 1").select(*own).toDF(*names)
