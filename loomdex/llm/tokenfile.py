"""Token ids as word-aligned Simple-8b blocks.

A file is a Parquet part whose rows are the binary blocks of one shard: a shard holds a range of doc_ids, its blocks
come in order, and each block has a header (``HEAD``), the table of its documents (id and number of ids), the bit
offset table of its runs and the coded words, so that any block decodes on its own and all its runs at once.

Coding: every 64-bit word has a 4-bit selector above 60 bits of payload that hold n ids of 60 // n bits each, for
the n of ``COUNTS``. Ids are cut into runs of ``RUN``; each run starts a new word and the block lists the word each
run starts at. An id of over 60 bits is an escape: a word with selector 15, then a word with the id itself. Encoding
advances all runs of a block by one word at a time; decoding unpacks all words of one selector at a time.

Defined results: a null text is empty; a document without ids has the end id alone. Documents come by doc_id, then in
the order in which they are read; a null doc_id comes last, as the largest long (which is reserved for it). Rows that
repeat a doc_id are documents of their own. The string of a special token is that token, wherever it stands in a text.
An empty table makes no files' rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import NULL_ID, arrow_map, as_bytes, batch, id_key, work_dir

#: Ids in a word, by selector from 0; 60 // n bits for each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
RUN = 120
#: Magic, version, documents, ids, runs, words.
HEAD = struct.Struct("<8sIIQII")
MAGIC = b"LOOMS8B\0"
VOCABULARY = "word_bpe_49k.json"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, the word each run starts at) of non-negative integers below 2**64."""
    ids = np.ascontiguousarray(ids, np.uint64)
    runs = -(-len(ids) // RUN)
    starts = np.arange(runs, dtype=np.int64) * RUN
    ends = np.minimum(starts + RUN, len(ids))
    # bits each id needs; an id that a double rounds up to a power of two may be given one more, which it can take
    width = np.zeros(len(ids) + max(COUNTS), np.uint8)
    width[: len(ids)] = np.frexp(ids.astype(np.float64))[1]
    # the widest id among the next n, for each n of COUNTS, by growing windows
    chosen = np.full(len(ids), ESCAPE, np.uint8)
    grown, n = width.copy(), 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        while n < COUNTS[selector]:
            step = min(n, COUNTS[selector] - n)
            shifted = np.zeros_like(grown)
            shifted[:-step] = grown[step:]
            grown = np.maximum(grown, shifted)
            n += step
        chosen[grown[: len(ids)] <= 60 // n] = selector
    at, used = starts.copy(), np.zeros(runs, np.int64)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (run, place in the run, word)
    live = np.arange(runs)
    counts = np.array([*COUNTS, 0, 0])
    while len(live):
        here = at[live]
        sel = chosen[here]
        left = ends[live] - here
        word = np.zeros(len(live), np.uint64)
        took = np.zeros(len(live), np.int64)
        for s in np.unique(sel):
            k = np.flatnonzero(sel == s)
            if s == ESCAPE:
                word[k] = np.uint64(ESCAPE) << np.uint64(60)
                rows.append((live[k], used[live[k]], word[k]))
                rows.append((live[k], used[live[k]] + 1, ids[here[k]]))
                took[k] = 1
                continue
            c = counts[s]
            bits = np.uint64(60 // c)
            # past the end of a run: zeros, which the number of ids of the run tells from ids
            span = here[k, None] + np.arange(c)
            inside = np.arange(c) < left[k, None]
            part = np.where(inside, ids[np.minimum(span, len(ids) - 1)], np.uint64(0))
            w = np.full(len(k), s, np.uint64) << np.uint64(60)
            for j in range(c):
                w |= part[:, j] << (np.uint64(j) * bits)
            word[k] = w
            took[k] = np.minimum(c, left[k])
            rows.append((live[k], used[live[k]], w))
        used[live] += 1 + (sel == ESCAPE)
        at[live] += took
        live = live[at[live] < ends[live]]
    first = np.zeros(runs + 1, np.int64)
    np.cumsum(used, out=first[1:])
    words = np.zeros(first[-1], np.uint64)
    for run, place, w in rows:
        words[first[run] + place] = w
    return words, first[:-1].astype(np.uint32)


def unpack(words: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """The ids that pack() packed."""
    out = np.zeros(total, np.uint64)
    if not total:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # a word after an escape is an id; escapes can't be told from ids without walking
        for a, b in zip(first, [*first[1:], len(words)], strict=True):
            k = int(a)
            while k < b:
                if sel[k] == ESCAPE:
                    literal[k + 1] = True
                    k += 1
                k += 1
    full = np.array([*COUNTS, 1, 0])[sel]
    full[sel == ESCAPE] = 0
    full[literal] = 1
    run = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    ends = np.cumsum(full)
    before = ends - full
    base = before[first.astype(np.int64)]
    begin = run * RUN + before - base[run]
    stop = np.minimum((run + 1) * RUN, total)
    out[begin[literal]] = words[literal]
    for s in np.unique(sel[~literal]):
        if s == ESCAPE:
            continue
        k = np.flatnonzero((sel == s) & ~literal)
        c = COUNTS[s]
        bits = np.uint64(60 // c)
        low = np.uint64((1 << int(bits)) - 1)
        for j in range(c):
            to = begin[k] + j
            ok = to < stop[k]
            out[to[ok]] = (words[k[ok]] >> (np.uint64(j) * bits)) & low
    return out


def to_block(doc_ids: list[int], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = pack(ids)
    return b"".join([HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(first), len(words)), np.array(doc_ids, np.int64).tobytes(), counts.astype(np.uint32).tobytes(), first.tobytes(), words.tobytes()])


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids)."""
    magic, version, docs, total, runs, n_words = HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    at = HEAD.size
    doc_ids = np.frombuffer(block, np.int64, docs, at)
    counts = np.frombuffer(block, np.uint32, docs, at + 8 * docs)
    first = np.frombuffer(block, np.uint32, runs, at + 12 * docs)
    words = np.frombuffer(block, np.uint64, n_words, at + 12 * docs + 4 * runs)
    return doc_ids, counts, unpack(words, first, total)


#: Latin letters up to U+024F, but for the dotted capital I, which is two characters in lower case.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable in Latin-1,
    else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


BYTE_CHARS = byte_chars()


PUNCTUATION = string.punctuation.encode()


class WordTokenizer(dict):
    """The tokenizers library, asked once for each word that is new to a bounded memo of two generations.

    The vocabulary's normaliser and splitting rules never look across white space, so words may be encoded apart. A
    text without non-ASCII characters is lower-cased before it is looked up, as the library would do itself. The
    library finds its special tokens in the text as it is, before any rule; a text that holds one goes to it whole.
    """

    def __init__(self, path: str, memo: int = 400_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # in a word that was lower-cased their strings are ordinary text
        self.merge = self.library.model.tokenize
        special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))).search if special else lambda _: None
        self.older: dict[bytes, bytes] = {}
        self.memo_size = memo

    def __missing__(self, word: bytes) -> bytes:
        """The ids of a word that the memo lacks. Letters, and the signs before and after them, are pre-tokens of their
        own (but for an apostrophe before letters, which may begin a contraction); letters go to the library's model at
        once, in lower case, as the characters that stand for their bytes."""
        out = self.older.get(word)
        if out is None:
            core = word.strip(PUNCTUATION)
            if core.isalpha():  # of bytes: ASCII letters
                text = core.decode("ascii").lower()
            elif LATIN.fullmatch(text := core.decode("utf-8")):
                text = "".join(map(BYTE_CHARS.__getitem__, text.lower().encode("utf-8")))
            else:
                text = None
            if len(core) == len(word) and text is not None:
                out = array("I", [t.id for t in self.merge(text)]).tobytes()
            elif text is None or word[: (at := word.index(core))].endswith(b"'"):
                out = array("I", self.library.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()
            else:
                before, after = word[:at], word[at + len(core) :]
                out = (self.sign(before) if before else b"") + self[core] + (self.sign(after) if after else b"")
        self[word] = out
        return out

    def sign(self, marks: bytes) -> bytes:
        """The ids of signs that stand before or after letters."""
        if (out := self.get(marks)) is None:
            out = self[marks] = array("I", self.library.encode(marks.decode("ascii"), add_special_tokens=False).ids).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        if len(self) > self.memo_size:
            self.older = dict(self)
            self.clear()
        out, get = [], self.__getitem__
        for t in texts:
            if self.special(t):
                out.append(array("I", self.whole.encode(t.decode("utf-8"), add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, t.lower().split() if t.isascii() else t.split())))
        return out


@cache
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.int64()), ("data", pa.binary())])
FILE_SQL = "shard int, block int, ids long, data binary"
#: The most shards; beyond so many times ``shard_rows`` documents, shards grow and hold more blocks.
MOST_SHARDS = 1 << 16


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, shard_rows: int = 8192, block_ids: int = 1 << 19) -> None:
    """Encode docs and write the blocks (shard, block, number of ids, data) to path, in ascending doc_id order.

    Shards are ranges of (doc_id, place in the input), which Spark cuts by a sample of bounded size; the place splits a
    doc_id that many rows share. A task holds one block and one slice of texts at a time, whatever its shard's size.
    """
    where = vocabulary or default_vocabulary()
    end = np.array([end_id], np.uint32).tobytes()
    rows = docs.select(id_key(id_col).alias("id"), F.monotonically_increasing_id().alias("place"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = min(MOST_SHARDS, max(1, -(-docs.count() // shard_rows)))
    dealt = rows.repartitionByRange(shards, "id", "place").sortWithinPartitions("id", "place").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(where)
        shard, block, ids, coded, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(c) // 4 for c in coded], np.uint32)
            return batch(FILE, [shard], [block], [size], [to_block(ids, counts, np.frombuffer(b"".join(coded), np.uint32))])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for d, c in zip(part.column(0).to_pylist(), words.encode(as_bytes(part.column(1))), strict=True):
                    if size >= block_ids:
                        yield flush()
                        block, ids, coded, size = block + 1, [], [], 0
                    ids.append(d)
                    coded.append(c + end)
                    size += len(c) // 4 + 1
        if coded:
            yield flush()

    dealt.transform(arrow_map, run, FILE_SQL).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, row, doc_id, ids: a row for each document, from the files."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc_ids, counts, ids = from_block(data)
                n = len(doc_ids)
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64)))
                yield batch(schema, [s] * n, [k] * n, np.arange(n, dtype=np.int32), pa.array(doc_ids, mask=doc_ids == NULL_ID), lists)

    return spark.read.schema(FILE_SQL).parquet(path).select("shard", "block", "data").transform(arrow_map, run, "shard int, block int, row int, doc_id long, ids array<bigint>")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, row, before (the ids of the block's earlier documents), doc_id, n_tokens, ids_crc32 of each
    document, from the files, without moving the ids."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc_ids, counts, ids = from_block(data.as_buffer())
                raw = memoryview(ids.astype("<u4").tobytes())
                counts = counts.astype(np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(doc_ids)
                yield batch(schema, [s] * n, [k] * n, np.arange(n, dtype=np.int32), ends - counts, pa.array(doc_ids, mask=doc_ids == NULL_ID), counts, crc)

    return spark.read.schema(FILE_SQL).parquet(path).select("shard", "block", "data").transform(arrow_map, run, "shard int, block int, row int, before long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Adds start: the ids of all documents before. rows: as from summaries of path. The files list the ids of each
    block, so sums run over the blocks of a shard, then over at most MOST_SHARDS shards; no text or id is read for them."""
    blocks = rows.sparkSession.read.schema(FILE_SQL).parquet(path).select("shard", "block", "ids")
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_shard", F.coalesce(F.sum("ids").over(in_shard), F.lit(0)))
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    base = blocks.join(shards, "shard").select("shard", "block", (F.col("earlier") + F.col("in_shard")).alias("base"))
    return rows.join(base, ["shard", "block"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return with_starts(summaries(spark, path), path).select("doc_id", "start", "n_tokens", "ids_crc32")
