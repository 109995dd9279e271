"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The alignment is relational: tokens by posexplode, cuts by an equi-join on text and end, groups by a running count of cuts
(``aligned``), links by a join of both sides. For tables of tokens ends come from a window over lengths and sides are joined
on text and group (``groups``); for the query ends come with a part's tokens, and sides are joined on the part, in order of
their groups (``listed``). Texts may be whole documents or any parts at which both tokenizers cut anyway.

The query uses that: neither tokenizer has a token over a single space between two characters that are no white space
(the first by its pattern; the second because no piece has a space mark behind another character, which is checked), so a
text is the sequence of its parts between such spaces, and equal parts have equal tokens, groups and links. ``coded`` writes
documents by batches of bounded size, each with a dictionary of its parts; all distinct parts are tokenized and aligned
once; a batch then gets what its dictionary needs, and no part, however frequent, is there twice in a batch. A text that
has no such space is one part, so nothing bounds a part but its text. Parts are known by 128 bits of their SHA-256, so
that no row of a token carries its text, and are dealt to as many buckets as their number asks for: a task sorts the
tokens of a bucket several times at once, which have to fit its memory.

Defined results: texts null, empty, or of which either tokenizer's bytes differ from space + text have no tokens: zeros and
an empty groups_sha256. Null and repeated doc_ids are documents of their own. An empty table gives no rows. Other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import MOST_BUCKETS, arrow_map, batch, bucket_count, bucketed, give_back, settled

VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A space at which both tokenizers cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"
#: Bytes of texts in a batch of documents, if no text is longer: the more, the fewer parts are in several dictionaries.
LOT = 12 << 20
#: Entries of dictionaries for each bucket of parts.
BUCKET_PARTS = 1 << 16


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARIES[0]), public_tokenizers.path(VOCABULARIES[1])


def byte_letters() -> dict[str, int]:
    """What byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        in_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            in_a[k] = bytes(letters[c] for c in token) if letters.keys() >= set(token) else b""
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        in_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode() for p in pieces]
        self.bytes_a, self.bytes_b = pa.array(in_a, pa.binary()), pa.array(in_b, pa.binary())

    def tokens(self, parts: list[str]) -> list[pa.Array]:
        """Of the parts, each read with a space before it: whether both give its bytes, the ids of the first and the bytes at which they
        end, and of the second. Without tokens where they don't."""
        whole = pa.array([(" " + p).encode() for p in parts], pa.binary())
        size = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
        same, sides = np.ones(len(parts), bool), []
        in_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        for ids, known in ((in_a, self.bytes_a), (self.b.encode(parts, num_threads=1), self.bytes_b)):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, counts.sum())
            got = known.take(pa.array(flat))
            each = pc.binary_length(got).to_numpy(zero_copy_only=False).astype(np.int64)
            fits = sums(each, np.concatenate([[0], np.cumsum(counts)])) == size
            same &= fits & equal(got.filter(pa.array(np.repeat(fits, counts))), whole.filter(pa.array(fits)), fits, size)
            sides.append((counts, flat, each))
        out = [pa.array(same)]
        for counts, flat, each in sides:
            of = np.repeat(same, counts)
            n, each = counts * same, each[of]
            first = np.concatenate([[0], np.cumsum(n)])
            run = np.concatenate([[0], np.cumsum(each)])
            bounds = pa.array(first.astype(np.int32))
            ends = run[1:] - np.repeat(run[first[:-1]], n)
            out += [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (flat[of], ends)]
        return out


def equal(got: pa.Array, whole: pa.Array, fits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each part whether got, the bytes of its tokens, are whole: both one after another, for parts that fit, where they are of one size."""
    one, other = (np.frombuffer(b"".join(x.to_pylist()), np.uint8) for x in (got, whole))
    out = np.zeros(len(fits), bool)
    out[fits] = sums(one != other, np.concatenate([[0], np.cumsum(size[fits])])) == 0
    return out


@cache
def falls_into_parts(path_b: str) -> bool:
    """Whether no piece of the second tokenizer goes over a space mark behind another character."""
    from sentencepiece import SentencePieceProcessor

    b = SentencePieceProcessor(model_file=path_b)
    return not any(MARK in b.id_to_piece(k).lstrip(MARK) for k in range(b.get_piece_size()))


@cache
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


CODED = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()), ("n_parts", pa.int64()), ("parts", pa.list_(pa.string()))])


def code(texts: pa.Array, parts: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of parts of each text, their codes one after another, the parts by code). parts: else each text is one."""
    counts, codes, found = encoded(texts, parts)
    return counts, codes, found.to_pylist()


def encoded(texts: pa.Array, parts: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As code, the parts as an array."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    lists = pc.split_pattern(texts, " ") if parts else pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    known = pc.dictionary_encode(lists.flatten())
    codes = known.indices.to_numpy().astype(np.int64)
    # a space isn't a cut beside white space: such texts, and empty ones, are cut by the rule itself
    odd = pc.equal(known.dictionary, "").to_numpy(zero_copy_only=False).copy()
    if parts:  # only a part that begins or ends outside printable ASCII can have white space there
        edge = np.flatnonzero(pc.match_substring_regex(known.dictionary, r"\A[^!-~]|[^!-~]\z").to_numpy(zero_copy_only=False))
        odd[edge] = [p != p.strip() or not p for p in known.dictionary.take(pa.array(edge)).to_pylist()]
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.unique(owner[odd[codes]]) if len(codes) else np.zeros(0, np.int64)
    if len(again):
        found = {int(d): (CUT.split(t) if parts else [t]) if (t := texts[int(d)].as_py()) else [] for d in again}
        more = pc.dictionary_encode(pa.concat_arrays([lists.flatten(), pa.array([p for d in again for p in found[int(d)]], pa.large_string())]))
        all_codes = more.indices.to_numpy().astype(np.int64)
        regular, rest = all_codes[: len(codes)], all_codes[len(codes) :]
        starts, at, pieces = np.concatenate([[0], np.cumsum(counts)]), 0, []
        for d in range(len(counts)):
            if d in found:
                pieces.append(rest[at : at + len(found[d])])
                at += len(found[d])
            else:
                pieces.append(regular[starts[d] : starts[d + 1]])
        counts, codes, known = np.array([len(p) for p in pieces]), np.concatenate(pieces), more
    there = np.bincount(codes, minlength=len(known.dictionary)) > 0
    return counts, (np.cumsum(there) - 1)[codes], known.dictionary.filter(pa.array(there))


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """batch, doc_ids, counts, codes, n_parts, parts: documents in batches of bounded size, as sequences of codes of the batch's distinct parts."""
    parts = falls_into_parts((paths or default_paths())[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get(), 0
        held: list[pa.RecordBatch] = []

        def lot() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            counts, codes, found = encoded(table.column(1), parts)
            found = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found.cast(pa.string()))
            return batch(CODED, [task.partitionId() << 32 | seen], [table.column(0).to_pylist()], [counts.tolist()], [packed(codes)], [len(found.values)], found)

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= LOT:
                yield lot()
                seen += 1
        if sum(x.num_rows for x in held):
            yield lot()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, "batch long, doc_ids array<long>, counts array<int>, codes binary, n_parts long, parts array<string>")


def part_key(part: str) -> Column:
    """What a part is known by: 16 bytes."""
    return F.substring(F.unhex(F.sha2(part, 256)), 1, 16)


def tokens(parts: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """key, same, a, a_end, b, b_end: ids of each part by both tokenizers, and the bytes at which they end. parts: key, part."""
    how = paths or default_paths()
    lists = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.binary()), ("same", pa.bool_()), ("a", lists), ("a_end", lists), ("b", lists), ("b_end", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*how)  # kept by the worker: 40 MB, and half a second for each bucket else
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                yield batch(schema, some.column(0), *both.tokens(some.column(1).to_pylist()))

    return parts.select("key", "part").transform(arrow_map, run, "key binary, same boolean, a array<int>, a_end array<int>, b array<int>, b_end array<int>")


def ends(side: DataFrame, key: str) -> DataFrame:
    """key, pos, id, end of side (key, pos, id, bytes): the byte at which each token ends."""
    return side.select(key, "pos", "id", F.sum("bytes").over(Window.partitionBy(key).orderBy("pos")).alias("end"))


def aligned(side: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """key, pos, id, group of side (key, pos, id, end): a token's group is the number of cuts before its end; a cut is where tokens of
    both end."""
    cut = other.select(key, "end", F.lit(1).alias("cut"))
    before = Window.partitionBy(key).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return side.select(key, "pos", "id", "end").join(cut, [key, "end"], "left").select(key, "pos", "id", F.count("cut").over(before).alias("group"))


def groups(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, group, a, b: the ids of both sides in each group, in order. Within a group every id of a is linked to every one of b."""
    a, b = ends(a, key), ends(b, key)

    def held(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
        return aligned(side, other, key).groupBy(key, "group").agg(ids.alias(name))

    return held(a, b, "a").join(held(b, a, "b"), [key, "group"])


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


def listed(keyed: DataFrame) -> DataFrame:
    """key, listed (the groups as text, as groups() has them) of rows (key, a, a_end, b, b_end): a key's tokens of both sides meet in one row,
    by group. All of it keeps the partitioning of keyed by key, if it
    has one and clusters of more columns may be held by fewer (see alignment)."""

    def side(name: str) -> DataFrame:
        return keyed.select("key", F.posexplode(F.arrays_zip(F.col(name).alias("id"), F.col(f"{name}_end").alias("end")))).select("key", "pos", "col.id", "col.end")

    def piece(x: Column, i: Column) -> Column:
        before = F.col("m")[i - 1]["at"]
        mark = F.when(i == 0, "").when(F.shiftright(before, 31) == F.shiftright(x["at"], 31), ",").when(F.shiftright(before, 32) == F.shiftright(x["at"], 32), "|").otherwise(";")
        return F.concat(mark, x["id"].cast("string"))

    def held(own: DataFrame, other: DataFrame, n: int) -> DataFrame:
        place = F.shiftleft(F.col("group").cast("long"), 32) + F.lit(n << 31) + F.col("pos")  # by group, side and position
        return aligned(own, other, "key").groupBy("key").agg(F.collect_list(F.struct(place.alias("at"), "id")).alias(f"m{n}"))

    a, b = side("a"), side("b")
    by = held(a, b, 0).join(held(b, a, 1), "key").select("key", F.sort_array(F.concat("m0", "m1")).alias("m"))
    return by.select("key", F.array_join(F.transform("m", piece), "").alias("listed"))


def links_of(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(n_a, n_b, n_groups and n_links of each listed text, the links one after another): every id of a group's first side with
    every one of its second, as one long, the first id above. Each distinct group is read once."""
    listed = pc.split_pattern(pc.fill_null(texts, ""), ";")
    known = pc.dictionary_encode(listed.flatten())
    at = known.indices.to_numpy().astype(np.int64)
    found = np.zeros((len(known.dictionary), 4), np.int64)
    links: list[list[int]] = []
    for k, group in enumerate(known.dictionary.to_pylist()):
        a, b = (side.split(",") for side in group.split("|")) if group else ((), ())
        links.append([int(x) << 32 | int(y) for x in a for y in b])
        found[k] = len(a), len(b), group != "", len(links[k])
    rows = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(found[at], axis=0)])[listed.offsets.to_numpy()], axis=0)
    flat = np.array([x for own in links for x in own], np.int64)
    size = found[at, 3]
    first = (np.cumsum(found[:, 3]) - found[:, 3])[at]
    spots = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    return dict(zip(("n_a", "n_b", "n_groups", "n_links"), rows.T, strict=True)), flat[spots]


LONGS = pa.list_(pa.int64())
CARRIED = pa.schema([("batch", pa.int64()), *((n, LONGS) for n in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.list_(pa.string())), ("links", pa.list_(pa.int32())), ("at", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
CARRIED_SQL = "batch long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, links array<int>, at binary, pair long, n long"


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values between each two bounds."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])[bounds])


def distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distinct values, in the order of their last places, without a sort. at: room for each value there may be."""
    place = np.arange(len(values))
    at[values] = place
    return values[at[values] == place]


def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a batch from its codes and what is known of its parts: a row of all their figures, and a row for each pair
    of ids with the number of documents that hold it linked."""
    row, right = left.to_pylist()[0], right.sort_by("code")
    counts = np.array(row["counts"], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    codes = unpacked(row["codes"], int(bounds[-1]))
    listed = right["listed"].combine_chunks()
    listed = pa.concat_arrays(listed.chunks) if isinstance(listed, pa.ChunkedArray) else listed
    of_part, flat = links_of(listed)
    texts = listed.to_pylist()
    same, n_links = of_part["n_groups"] > 0, of_part["n_links"]  # a part with tokens has a group
    starts = np.concatenate([[0], np.cumsum(n_links)])
    pairs, at = np.unique(flat, return_inverse=True)
    good = (counts > 0) & (sums(~same[codes], bounds) == 0)
    figures = {n: sums(of[codes], bounds) * good for n, of in of_part.items()}
    docs_of, sha = np.zeros(len(pairs), np.int64), []
    kind_at, pair_at = np.zeros(len(same), np.int64), np.zeros(len(pairs), np.int64)
    for d in range(len(counts)):
        if not good[d]:
            sha.append("")
            continue
        own = codes[bounds[d] : bounds[d + 1]]
        sha.append(hashlib.sha256(";".join([texts[c] for c in own.tolist()]).encode()).hexdigest())
        kinds = distinct(own, kind_at)
        n = n_links[kinds]
        spots = np.arange(n.sum()) + np.repeat(starts[kinds] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        docs_of[distinct(at[spots], pair_at)] += 1
    one = [row["batch"], *(figures[n].tolist() for n in ("n_a", "n_b", "n_groups", "n_links")), sha, n_links.tolist(), packed(at), None, None]
    head = pa.Table.from_pylist([dict(zip(CARRIED.names, one, strict=True))], schema=CARRIED)
    tail = {n: pa.nulls(len(pairs), CARRIED.field(n).type) for n in CARRIED.names} | {"batch": pa.array(np.full(len(pairs), row["batch"])), "pair": pa.array(pairs), "n": pa.array(docs_of)}
    out = pa.concat_tables([head, pa.table(tail, schema=CARRIED)])
    give_back()
    return out


RESULT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a batch's documents, from what assembled() says of it and the corpus's counts of its pairs."""
    row, right = left.to_pylist()[0], right.sort_by("pair")
    bounds = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))])
    codes, starts = unpacked(row["codes"], int(bounds[-1])), np.concatenate([[0], np.cumsum(np.array(row["links"], np.int64))])
    at, good = unpacked(row["at"], int(starts[-1])), np.array(row["n_groups"], np.int64) > 0
    by_part = {n: sums(right[n].to_numpy().astype(np.int64)[at], starts) for n in ("best", "count")}
    best, total = (sums(by_part[n][codes], bounds) * good for n in ("best", "count"))
    give_back()
    return pa.table([row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], best.tolist(), total.tolist(), row["sha"]], schema=RESULT)


def counts_of(pairs: DataFrame) -> DataFrame:
    """pair, count, best of rows (pair, n): the corpus-wide count, and 1 where no pair of the same first id has a higher one."""
    count = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    first = F.shiftright("pair", 32)
    top = count.groupBy(first.alias("first")).agg(F.max("count").alias("top"))
    return count.withColumn("first", first).join(top, "first").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    spark, buckets = docs.sparkSession, bucket_count(docs)
    batches = bucketed(coded(docs, paths=paths), "coded", "batch", buckets)
    entries = batches.select(F.col("batch").alias("of"), F.posexplode("parts").alias("code", "part"))
    coded_docs = batches.drop("n_parts", "parts")

    def assembly() -> DataFrame:
        n = max(buckets, min(-(-(batches.agg(F.sum("n_parts")).first()[0] or 0) // BUCKET_PARTS), MOST_BUCKETS))
        moved = entries.repartition(n, part_key("part"))  # once: a task gets and writes one bucket
        held = bucketed(moved.withColumn("key", part_key("part")).sortWithinPartitions("key"), "held", "key", n)  # so that later sorts find runs
        keyed = bucketed(tokens(held.select("key", "part").distinct(), paths), "tokens", "key", n)
        of_key = listed(keyed.filter("same").select("key", "a", "a_end", "b", "b_end"))
        of_batch = held.select("of", "code", "key").join(of_key, "key", "left").select("of", "code", "listed")
        return coded_docs.groupBy("batch").cogroup(of_batch.groupBy("of")).applyInArrow(assembled, CARRIED_SQL)

    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # joins by key and end keep the partitioning by key
        carried = settled(assembly, "assembled", lambda df, tag: bucketed(df, tag, "batch", buckets))
    pairs = carried.filter("pair is not null").select(F.col("batch").alias("of"), "pair", "n")
    figures = pairs.drop("n").join(counts_of(pairs), "pair")
    rows = coded_docs.join(carried.filter("pair is null").drop("pair", "n"), "batch")
    return rows.groupBy("batch").cogroup(figures.groupBy("of")).applyInArrow(counted, RESULT_SQL)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: alignment(spark.read.parquet(f"{sf_dir}/documents.parquet")), "alignment")
