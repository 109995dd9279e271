"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a whole vocabulary entry gets its id by
one probe, checked against the entry's bytes. Tier two takes the misses: the bytes form a linked list, a heap holds
the ranks of adjacent pairs, and the lowest rank merges first, the leftmost of equals, in O(n log n) for a
pre-token of any length. Results of both tiers are kept in a bounded memo of pre-tokens.

Defined results: a null text is empty; an empty text has no ids. Special tokens don't exist: their strings are
ordinary text. Rows that repeat a doc_id get a row each. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, batch, long_lists

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How many words, and how many pre-tokens, a generation of the memo holds.
MEMO = 400_000
#: Fixed value: the characters with the Unicode property White_Space.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern for which a single space between others always begins a pre-token; others are matched as a whole.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """A minimal perfect hash by displacement: keys go to buckets; each bucket, largest first, takes the first
    displacement that puts all its keys into free slots. There are as many slots as keys."""

    def __init__(self, keys: list[bytes], load: int = 2, built: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """built: the displacements and each slot's key, as found for these keys before."""
        self.n = n = max(1, len(keys))
        self.m = max(1, n // load)
        if built is not None:
            self.shift, self.slot_key = built[0], built[1].tolist()
            self.shifts = self.shift.tolist()
            return
        hashes = [self.hashes(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for k, (h, _, _) in enumerate(hashes):
            buckets[h % self.m].append(k)
        self.shift = np.zeros(self.m, np.int64)
        self.slot_key: list[int] = [-1] * n
        free_at = 0
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # any free slot will do: the displacement names it
                while self.slot_key[free_at] >= 0:
                    free_at += 1
                self.shift[b] = -1 - free_at
                self.slot_key[free_at] = own[0]
                continue
            d = 0
            while True:
                slots = [(hashes[k][1] + d * hashes[k][2]) % n for k in own]
                if len(set(slots)) == len(own) and all(self.slot_key[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for k, s in zip(own, slots, strict=True):
                self.slot_key[s] = k
        self.shifts = self.shift.tolist()

    @staticmethod
    def hashes(key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return h & 0xFFFFF, (h >> 20) & 0x3FFFFF, (h >> 42) | 1

    def slot(self, key: bytes) -> int:
        a, b, c = self.hashes(key)
        d = self.shifts[a % self.m]
        return -1 - d if d < 0 else (b + d * c) % self.n


@dataclass(frozen=True)
class Tables:
    """What a codec finds out about its vocabulary, as arrays: the hash's displacements and slots, and of each merge the ids that meet
    and the id they give. Made once on the driver and sent with the tasks, which read the vocabulary's file only."""

    shift: np.ndarray
    slots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray

    @staticmethod
    def of(ranks: dict[bytes, int]) -> Tables:
        found = PerfectHash(list(ranks))
        merges = [(a, b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        return Tables(found.shift, np.array(found.slot_key, np.int32), *np.array(merges, np.int32).reshape(-1, 3).T)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO, tables: Tables | None = None) -> None:
        tables = tables or Tables.of(ranks)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        tokens = list(ranks)
        self.hash = PerfectHash(tokens, built=(tables.shift, tables.slots))
        self.entry = [tokens[k] if k >= 0 else None for k in self.hash.slot_key]
        self.rank = [ranks[tokens[k]] if k >= 0 else -1 for k in self.hash.slot_key]
        #: By left id: the ids that may follow it, and what the two merge into.
        self.follows: list[dict[int, int]] = [{} for _ in self.bytes_of]
        for x, y, r in zip(tables.left.tolist(), tables.right.tolist(), tables.merged.tolist(), strict=True):
            self.follows[x][y] = r
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: By two bytes that follow each other, as one number: what they merge into.
        self.byte_pairs = [self.follows[a].get(b, -1) if a >= 0 else -1 for a in self.byte_id for b in self.byte_id]
        self.split = regex.compile(rust_classes(pattern)).findall
        #: Two generations of what was met lately: words with the space before them, and pre-tokens.
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.memo_size = memo
        self.spaced = pattern == SPACED

    def forget(self) -> None:
        """Empty the memo: a worker outlives its task, and other work needs the memory meanwhile."""
        self.chunks, self.older_chunks, self.pieces, self.older_pieces = {}, {}, {}, {}

    def lookup(self, piece: bytes) -> int:
        """The id of a vocabulary entry, or -1."""
        s = self.hash.slot(piece)
        return self.rank[s] if self.entry[s] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no entry: lowest rank first, then leftmost, over linked bytes."""
        n, follows, push, pop = len(piece), self.follows, heapq.heappush, heapq.heappop
        ids, pairs = list(map(self.byte_id.__getitem__, piece)), self.byte_pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # what a part and the next merge into
        heap = [r << 32 | i for i, r in enumerate(merged) if r >= 0]
        merged.append(-1)
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if merged[i] != r:
                continue  # one of the two has merged since
            gone = after[i]
            ids[i] = r
            merged[gone] = ids[gone] = -1
            k = after[i] = after[gone]
            if k < n:
                before[k] = i
                merged[i] = m = follows[r].get(ids[k], -1)
                if m >= 0:
                    push(heap, m << 32 | i)
            else:
                merged[i] = -1
            h = before[i]
            if h >= 0:
                merged[h] = m = follows[ids[h]].get(r, -1)
                if m >= 0:
                    push(heap, m << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, token: str) -> bytes:
        """The ids of one pre-token as 32-bit little-endian integers."""
        out = self.older_pieces.get(token)
        if out is None:
            data = token.encode("utf-8")
            r = self.lookup(data)
            out = r.to_bytes(4, "little") if r >= 0 else np.array(self.merge(data), np.uint32).tobytes()
        if len(token) <= 64:
            if len(self.pieces) >= self.memo_size:
                self.older_pieces, self.pieces = self.pieces, {}
            self.pieces[token] = out
        return out

    def whole(self, text: str) -> bytes:
        piece = self.piece
        return b"".join([self.pieces.get(t) or piece(t) for t in self.split(text)])

    def chunk(self, word: str) -> bytes:
        """The ids of a space and the word after it."""
        out = self.older_chunks.get(word)
        if out is None:
            marks = word[-1] in ".,;:!?"
            if (core := word[:-1] if marks else word).isalpha():
                out = self.pieces.get(" " + core) or self.piece(" " + core)
                if marks:
                    out += self.pieces.get(word[-1]) or self.piece(word[-1])
            else:
                out = self.whole(" " + word)
        if len(word) <= 64:
            if len(self.chunks) >= self.memo_size:
                self.older_chunks, self.chunks = self.chunks, {}
            self.chunks[word] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of text. A single space between two characters that are no white space begins a pre-token, so
        such a text may be cut before each space and the cut parts encoded, and remembered, one by one."""
        if not self.spaced or not text or text[0] == " " or text[-1] == " " or any(w + " " in text or " " + w in text for w in WHITE):
            return np.frombuffer(self.whole(text), np.uint32)
        first, *rest = text.split(" ")
        chunk = self.chunk
        return np.frombuffer(self.whole(first) + b"".join([self.chunks.get(t) or chunk(t) for t in rest]), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return decode(self.bytes_of, ids)


def decode(bytes_of: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids.tolist()))


def rust_classes(pattern: str) -> str:
    r"""The pattern with \s as tiktoken's engine reads it: White_Space, without the separators U+001C to U+001F."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def tables_of(path: str) -> Tables:
    return Tables.of(load_ranks(path))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, memo: int = MEMO, tables: Tables | None = None) -> Codec:
    """One for a worker; the vocabulary is part of the installation, not of the data. tables: as the driver has made them."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern, memo, tables or tables_of(path))
    found = _CODECS[path, pattern]
    found.memo_size = memo
    return found


@cache
def vocabulary_bytes(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def default_codec() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids (array<int>): a row for each row of docs."""
    how = vocabulary or default_codec()
    schema, tables = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), tables_of(how[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*how, tables=tables)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                lists = long_lists(np.concatenate(ids).astype(np.int32), [len(x) for x in ids], pa.int32())
                yield batch(schema, part.column(0), lists)
        c.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, "doc_id long, ids array<int>")


def decimals(bytes_of: list[bytes]) -> list[bytes]:
    return [b"%d" % k for k in range(len(bytes_of))]


def digest(ids: np.ndarray, bytes_of: list[bytes], decimal: list[bytes]) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the listed ids, SHA-256 of the bytes that they decode to)."""
    listed = b",".join(map(decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(bytes_of, ids)).hexdigest()


DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
DIGESTS_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from doc_id, ids; the bytes come from decoding the ids."""
    how = vocabulary or default_codec()
    schema = pa.schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = vocabulary_bytes(how[0])
        decimal = decimals(bytes_of)
        for b in batches:
            flat, ends = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            got = [digest(flat[s:e], bytes_of, decimal) for s, e in zip(ends, ends[1:], strict=False)]
            yield batch(schema, b.column(0), *([g[k] for g in got] for k in range(3)))

    return encoded.transform(arrow_map, run, DIGESTS_SQL)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, keep_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """The digests of encode(docs), and with keep_ids the ids, in one pass: each text is encoded and its ids decoded by
    the same worker, so a task holds one codec and the ids don't pass through the JVM in between. memo: the size of a
    generation of the memo, which trades a worker's memory against its time, never results."""
    how = vocabulary or default_codec()
    schema, tables = pa.schema(DIGESTS + [("ids", pa.list_(pa.int32()))] * keep_ids), tables_of(how[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*how, memo, tables)
        decimal = decimals(c.bytes_of)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                got = [digest(x, c.bytes_of, decimal) for x in ids]
                lists = [long_lists(np.concatenate(ids).astype(np.int32), [len(x) for x in ids], pa.int32())] if keep_ids else []
                yield batch(schema, part.column(0), *([g[k] for g in got] for k in range(3)), *lists)
        c.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, DIGESTS_SQL + ", ids array<int>" * keep_ids)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
