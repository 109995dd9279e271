"""Substring dedup by prefix-partitioned suffix trees.

A window is ``length`` (20) consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts earlier: in a document with a smaller id, or earlier in the same one. Windows are judged
on the input.

1. Documents are gathered into cells of a few megabytes, stored compressed. An anchor is the start of the ``GRAM`` (5)
   words of a window with the least hash, the leftmost of equals; so equal windows have it at the same place. The trees
   are sparse: their suffixes start at anchors only, about two of seventeen words.
2. A suffix's prefix is its first five words. Each cell sends the prefixes it has and how often, and a bit tells it which
   occur twice anywhere; only windows around those can repeat. Prefixes are dealt to groups that fit in memory. A prefix
   that more than ``heavy`` suffixes share would not fit: it is grown to the whole depth of 20 words.
3. A group gets the suffixes of its prefixes with the words around them, and builds their suffix tree: the leaves in
   order, and the length that neighbours have in common, which marks the internal nodes at each depth. A window that
   begins o words before its anchor is a node at depth 20 - o together with a node at depth o of the tree of the words
   before, read backwards. Deep internal nodes of two leaves or more are the repeats; every leaf but the first is a
   later occurrence. Of equal windows of one cell only the first is sent.
4. At whole depth a prefix is a node of its own, whatever its leaves, so of it only the first is sought, by a minimum that
   is partial before it moves, and the others meet that by a join, which Spark splits.
5. Each cell gets word of its windows that start elsewhere earlier, adds those that repeat within itself, and removes the
   union of their words; overlapping windows join to maximal repeats.

Hashes choose anchors and deal out work. Windows are compared by their words: in the trees and within a cell as such, at
whole depth by a 128-bit BLAKE2 digest of them. Nothing is paired or expanded: a passage that a third of all documents
share costs a row for each window of each cell that holds it.

Defined results: a null text has no words. Rows that share a doc_id count as one document: none of them is earlier
than another at the same start. A null doc_id comes last. Documents shorter than a window stay whole. Other columns
of the input are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import NULL_ID, arrow_map, as_bytes, batch, id_key, materialize, remove, store

LENGTH = 20
GRAM = 5
#: A cell ends at so many bytes of text or documents; a longer document is a cell of its own.
CELL_BYTES = 2 << 20
CELL_DOCS = 4096
#: Bits of a prefix's hash; the other three of a word tell how often it occurs.
BITS = 61
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    return _powers(1 << max(10, (n - 1).bit_length()), base)[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, modulo 2**64."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h), _BASE), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(len(h) - n + 1, _INVERSE))


def leftmost(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least of each n consecutive values, where the first of them stands)."""
    at, have = np.arange(len(x)), 1
    while have < n:
        step = min(have, n - have)
        less = x[step:] < x[:-step]
        x, at = np.where(less, x[step:], x[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return x, at


class Cell:
    """The words of some documents one after another. start[d] is the first word of document d."""

    def __init__(self, texts: list[bytes], length: int = LENGTH) -> None:
        self.length = length
        split = [t.split() for t in texts]
        self.words: list[bytes] = [w for ws in split for w in ws]
        self.counts = np.array([len(ws) for ws in split], np.int64)
        self.start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.counts, out=self.start[1:])
        n = len(self.words)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        #: window starts: those whose window ends in the same document
        self.windows = np.flatnonzero(self.start[self.doc[: n - length + 1] + 1] - np.arange(n - length + 1) >= length) if n >= length else np.zeros(0, np.int64)

    def sketch(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the least hash of each window, its anchor, the distinct hashes of anchors, how many anchors have each)."""
        if not len(self.windows):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = rolling(self.hashes, GRAM) >> np.uint64(64 - BITS)
        least, at = (x[self.windows] for x in leftmost(g, self.length - GRAM + 1))
        anchors = at[np.flatnonzero(np.diff(at, prepend=-1))]  # anchors don't go back as windows go on
        return least, at, *np.unique(g[anchors], return_counts=True)

    def window(self, at: int) -> list[bytes]:
        return self.words[at : at + self.length]

    def leaders(self, starts: np.ndarray, where: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """For each of the windows that begin at starts the first that has the same words; where, pos: its document's id
        and its place in it."""
        if not len(starts):
            return starts
        names = rolling(self.hashes, self.length)[starts]
        for exact in (False, True):
            if exact:  # two windows have one hash but not the same words: name them by the words
                told: dict[bytes, int] = {}
                names = np.array([told.setdefault(b" ".join(self.window(s)), len(told)) for s in starts.tolist()], np.int64)
            by = np.lexsort((pos, where, names))
            fresh = np.ones(len(by), bool)
            fresh[1:] = names[by][1:] != names[by][:-1]
            first = np.empty(len(by), np.int64)
            first[by] = by[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
            other = np.flatnonzero(first != np.arange(len(by)))
            if exact or all(self.window(a) == self.window(b) for a, b in zip(starts[other].tolist(), starts[first[other]].tolist(), strict=True)):
                return first
        raise AssertionError


def compress(texts: list[bytes]) -> bytes:
    head = np.array([len(texts), *map(len, texts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def decompress(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))])
    return [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def cells(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """cell, words, ids, texts (compressed): documents gathered as they are read."""
    schema = pa.schema([("cell", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return batch(schema, [part << 32 | k], [sum(len(t.split()) for t in texts)], [np.array(ids, np.int64).tobytes()], [compress(texts)])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if texts and (size + len(t) > CELL_BYTES or len(texts) >= CELL_DOCS):
                    yield flush()
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield flush()

    rows = docs.select(id_key(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.transform(arrow_map, run, "cell long, words long, ids binary, texts binary")


def dealt(keys: np.ndarray, groups: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(groups that occur, for each where its keys stand) of keys dealt out by their hash."""
    g = (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) % groups
    order = np.argsort(g, kind="stable")
    found, begin = np.unique(g[order], return_index=True)
    return found, np.split(order, begin[1:]) if len(found) else []


def by_group(rows, schema: pa.Schema):
    """rows, whose batches hold a cell's records group by group, with larger batches."""
    from loomdex.llm.linededup import coalesced

    return coalesced(rows, schema, 4096)


def scaled(counts: np.ndarray) -> np.ndarray:
    """The least powers of 4 that are no less than counts, up to 4**7."""
    return np.minimum(np.ceil(np.log2(np.maximum(counts, 1)) / 2), 7).astype(np.uint64)


class Judged:
    """The windows of a cell that may repeat, which of them lead the others of the same words, and what is sent of them.

    told: by group, for each hash of an anchor in the order it was sent, a bit for whether it occurs twice and a bit for
    whether its prefix is heavy.
    """

    def __init__(self, cell: Cell, ids: np.ndarray, told: dict[int, bytes], groups: int) -> None:
        self.cell, self.groups = cell, groups
        least, at, values, _ = cell.sketch()
        state = np.zeros(len(values), np.int8)
        for g, k in zip(*dealt(values, groups), strict=True):
            half = -(-len(k) // 8)
            raw = np.frombuffer(told[g], np.uint8)
            state[k] = np.unpackbits(raw[:half], count=len(k)) + np.unpackbits(raw[half:], count=len(k))
        kept = np.flatnonzero(state[np.searchsorted(values, least)])
        self.starts, self.anchor, self.state = cell.windows[kept], at[kept], state[np.searchsorted(values, least[kept])]
        self.value = least[kept]
        doc = cell.doc[self.starts]
        self.where, self.pos = ids[doc], self.starts - cell.start[doc]
        self.first = cell.leaders(self.starts, self.where, self.pos)
        leads = self.first == np.arange(len(kept))
        self.light, self.heavy = np.flatnonzero(leads & (self.state == 1)), np.flatnonzero(leads & (self.state == 2))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(for each light window the suffix it belongs to, the light window that each suffix begins with)."""
        a = self.anchor[self.light]
        new = np.diff(a, prepend=-1) != 0
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def sent(self) -> tuple[np.ndarray, list[bytes]]:
        """(groups, for each group its suffixes with the words around them)."""
        c, at = self.cell, self.light
        if not len(at):
            return np.zeros(0, np.int64), []
        _, begin = self.suffixes()
        a = self.anchor[at][begin]
        before = self.anchor[at] - self.starts[at]
        lo, hi = a - np.maximum.reduceat(before, begin), a - np.minimum.reduceat(before, begin) + c.length
        rec = np.empty(len(a), record(c.length))
        rec["id"], rec["pos"] = self.where[at][begin], (self.pos[at] + before)[begin]
        rec["left"], rec["words"] = a - lo, hi - lo
        rec["mask"] = np.bitwise_or.reduceat(np.uint64(1) << before.astype(np.uint64), begin)
        around = [b" ".join(c.words[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
        found, parts = dealt(self.value[at][begin], self.groups)
        zstd = zstandard.ZstdCompressor(level=1)
        out = []
        for k in parts:
            out.append(np.int64(len(k)).tobytes() + rec[k].tobytes() + zstd.compress(b" ".join([around[j] for j in k.tolist()])))
        return found, out

    def later(self, told: dict[int, bytes], hot: np.ndarray) -> np.ndarray:
        """The starts of the windows whose words start earlier. told: by group, for each suffix that was sent to it, in
        order, a bit for each window that starts earlier elsewhere; hot: which of the heavy windows do."""
        late = np.zeros(len(self.starts), bool)
        if len(self.light):
            suffix, begin = self.suffixes()
            masks = np.zeros(len(begin), np.uint64)
            for g, k in zip(*dealt(self.value[self.light][begin], self.groups), strict=True):
                if g in told:
                    masks[k] = np.frombuffer(told[g], record(self.cell.length)["mask"])
            before = (self.anchor[self.light] - self.starts[self.light]).astype(np.uint64)
            late[self.light] = masks[suffix] >> before & np.uint64(1) > 0
        late[self.heavy[hot]] = True
        first = self.first
        return self.starts[late[first] | (self.where != self.where[first]) | (self.pos != self.pos[first])]


def record(length: int) -> np.dtype:
    """A suffix: its document, the place of its anchor, how many words before the anchor and in all are sent, and a bit for
    each window, by how many words it begins before the anchor."""
    return np.dtype([("id", "<i8"), ("pos", "<u4"), ("left", "u1"), ("words", "u1"), ("mask", "<u2" if length - GRAM < 16 else "<u8")])


def branches(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the leaves, how much each has in common with the one before it): a suffix tree of rows of words."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    differ = rows[order][1:] != rows[order][:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)


def node_of(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf its node at a depth."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < depth)
    return out


def repeats(rec: np.ndarray, words: list[bytes], length: int) -> np.ndarray:
    """For each suffix a bit for each of its windows whose words start earlier in another."""
    reach = length - GRAM  # words before an anchor
    told = {w: k for k, w in enumerate(dict.fromkeys(words))}
    n = rec["words"].astype(np.int64)
    rows = np.full((len(rec), reach + length), -1, np.int32)
    begin = np.arange(len(rec)) * rows.shape[1] + reach - rec["left"]
    rows.ravel()[np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)] = np.fromiter(map(told.__getitem__, words), np.int32, len(words))
    after, before = branches(rows[:, reach:]), branches(rows[:, :reach][:, ::-1])
    out = np.zeros(len(rec), np.uint64)
    mask, ids, pos = rec["mask"].astype(np.uint64), rec["id"], rec["pos"].astype(np.int64)
    for o in range(reach + 1):
        at = np.flatnonzero(mask >> np.uint64(o) & np.uint64(1))
        if len(at) < 2:
            continue
        node = node_of(*after, length - o)[at] * len(rec) + node_of(*before, o)[at]
        by = at[np.lexsort((pos[at], ids[at], node))]
        node = np.sort(node)
        head = np.maximum.accumulate(np.where(np.diff(node, prepend=-1) != 0, np.arange(len(by)), 0))
        late = (ids[by] != ids[by][head]) | (pos[by] != pos[by][head])
        out[by[late]] |= np.uint64(1 << o)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_size: int = 150_000, heavy: int | None = None) -> tuple[DataFrame, int]:
    """(for each cell its texts, what was told of its prefixes, and what repeats from elsewhere; how many groups there are):
    see remove_repeats. group_size: about how many prefixes a group gets; heavy: how many suffixes a prefix may have
    before it is grown (by default half of what a group gets)."""
    if not GRAM < length <= GRAM + 64:
        raise ValueError(f"a window has {GRAM + 1} to {GRAM + 64} words")
    spark, heavy = docs.sparkSession, heavy or max(2, group_size // 2)
    at = store(cells(docs, id_col, text_col, length), "cells")
    held = spark.read.schema("cell long, words long, ids binary, texts binary").parquet(at)
    # of w values in a row about two in w + 1 are minima
    n_minima = (held.agg(F.sum("words")).first()[0] or 0) * 2 // (length - GRAM + 2)
    groups = max(64, n_minima // group_size + 1)
    sent_schema, sent_sql = pa.schema([("grp", pa.int32()), ("cell", pa.int64()), ("data", pa.binary())]), "grp int, cell long, data binary"

    def send_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, values, n = Cell(decompress(texts), length).sketch()
                found, parts = dealt(values, groups)
                v = values | scaled(n) << np.uint64(BITS)
                yield batch(sent_schema, found.astype(np.int32), [cell] * len(found), [v[k].tobytes() for k in parts])

    def count(table: pa.Table) -> pa.Table:
        """Of a group's prefixes those that occur twice and those that are heavy, as bits for those of each cell."""
        data = [np.frombuffer(d, np.uint64) for d in table.column("data").to_pylist()]
        v = np.concatenate(data)
        _, back = np.unique(v & np.uint64((1 << BITS) - 1), return_inverse=True)
        n = np.bincount(back, 4.0 ** (v >> np.uint64(BITS)).astype(np.float64))[back]
        ends = np.cumsum([len(d) for d in data])[:-1]
        bits = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(n > 1, ends), np.split(n > heavy, ends), strict=True)]
        many = [bool(y.any()) for y in np.split(n > heavy, ends)]
        return pa.table([table.column("grp"), table.column("cell"), pa.array(bits, pa.binary()), pa.array(many)], names=["grp", "cell", "data", "heavy"])

    sent = held.select("cell", "texts").transform(arrow_map, by_group(send_prefixes, sent_schema), sent_sql)
    # the bits of a cell are a quarter of a byte for each of its prefixes
    bits = sent.groupBy("grp").applyInArrow(count, sent_sql + ", heavy boolean")
    bits = bits.groupBy("cell").agg(F.collect_list(F.struct("grp", "data")).alias("bits"), F.max("heavy").alias("heavy"))
    told = materialize(held.select("cell", "ids", "texts").join(bits, "cell", "left"), "cells-told")
    remove(spark, at)

    def judged(b: pa.RecordBatch) -> Iterator[tuple[int, Judged]]:
        for cell, ids, texts, flags in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            yield cell, Judged(Cell(decompress(texts), length), np.frombuffer(ids, np.int64), {f["grp"]: f["data"] for f in flags or []}, groups)

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, j in judged(b):
                found, parts = j.sent()
                yield batch(sent_schema, found.astype(np.int32), [cell] * len(found), parts)

    def tree(table: pa.Table) -> pa.Table:
        """For each suffix of a group, in the order its cell sent them, its windows that start earlier in another."""
        kind, recs, words, zstd = record(length), [], [], zstandard.ZstdDecompressor()
        for d in table.column("data").to_pylist():
            n = int(np.frombuffer(d, np.int64, 1)[0])
            recs.append(np.frombuffer(d, kind, n, 8))
            words += zstd.decompress(d[8 + n * kind.itemsize :]).split(b" ")
        late = repeats(np.concatenate(recs), words, length).astype(kind["mask"])
        parts = np.split(late, np.cumsum([len(r) for r in recs])[:-1])
        some = pa.array([k for k, x in enumerate(parts) if x.any()], pa.int64())
        return pa.table([table.column("grp").take(some), table.column("cell").take(some), pa.array([parts[k].tobytes() for k in some.to_pylist()], pa.binary())], schema=sent_schema)

    suffixes = told.select("cell", "ids", "texts", "bits").transform(arrow_map, by_group(send_suffixes, sent_schema), sent_sql)
    light = suffixes.groupBy("grp").applyInArrow(tree, sent_sql).groupBy("cell").agg(F.collect_list(F.struct("grp", "data")).alias("light"))
    whole_schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("pos", pa.int64()), ("cell", pa.int64()), ("n", pa.int32())])

    def send_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, j in judged(b):
                keys = [hashlib.blake2b(b" ".join(j.cell.window(s)), digest_size=16).digest() for s in j.starts[j.heavy].tolist()]
                yield batch(whole_schema, keys, j.where[j.heavy], j.pos[j.heavy], [cell] * len(keys), np.arange(len(keys), dtype=np.int32))

    whole = told.filter("heavy").select("cell", "ids", "texts", "bits").transform(arrow_map, by_group(send_whole, whole_schema), "key binary, id long, pos long, cell long, n int")
    whole = materialize(whole, "whole-windows")
    first = materialize(whole.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("id", "pos")).alias("first")).filter("many > 1").drop("many"), "first-windows")
    hot = whole.join(first, "key").filter(F.struct("id", "pos") != F.col("first")).groupBy("cell").agg(F.collect_list("n").alias("hot"))
    return told.drop("heavy").join(light, "cell", "left").join(hot, "cell", "left"), groups


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space): a row for each row of docs."""
    return _apply(docs, id_col, text_col, length, False, **how)


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, digest: bool, **how) -> DataFrame:
    held, groups = removals(docs, id_col, text_col, length, **how)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts, flags, light, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                c = Cell(decompress(texts), length)
                j = Judged(c, ids, {f["grp"]: f["data"] for f in flags or []}, groups)
                starts = j.later({f["grp"]: f["data"] for f in light or []}, np.array(hot or [], np.int64))
                edge = np.zeros(len(c.words) + 1, np.int32)
                edge[starts] += 1
                np.subtract.at(edge, starts + length, 1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[c.start[1:]] - removed[c.start[:-1]]
                kept = []
                for d, n in enumerate(removed.tolist()):
                    lo, hi = int(c.start[d]), int(c.start[d + 1])
                    w = c.words[lo:hi] if not n else [x for x, g in zip(c.words[lo:hi], gone[lo:hi].tolist(), strict=True) if not g]
                    text = b" ".join(w)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8"))
                yield batch(schema, pa.array(ids, mask=ids == NULL_ID), c.counts, removed, kept)

    return held.select("ids", "texts", "bits", "light", "hot").transform(arrow_map, run, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _apply(docs, "doc_id", "text", LENGTH, digest=True).withColumnRenamed("kept", "kept_sha256")
