"""A stored inverted index: postings in buckets of their term, in segments that are never rewritten.

A segment holds the rows that one update brought (key, length, and their part and place in it), their postings, and the keys
that it made void in the segments before it: those it brings again and those that are deleted. A part is what a task read of
the rows at a time; its postings are packed where they are read, a block for each bucket, with places in the part instead of
keys, and only blocks move. A search reads the buckets of its terms and nothing else of the postings; what it asks for of a
part's blocks meets the part's live rows, so a row's terms come together without a shuffle of single postings. Frequencies,
row counts and lengths are those of the live rows, so scores equal those of an index made anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions.work import held_for, written
from loomdex.operators import lexical, scan
from loomdex.sources.snapshots import Conflict, Snapshots

BUCKETS = 256
#: Bytes of texts or tokens of a part, and tokens of one that compact makes, about.
PART, TOKENS = 8 << 20, 1 << 20
#: The bucket under which a part's rows are packed.
ROWS = -1

PACKED = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary())])
PACKED_SHAPE = "part long, bucket int, block binary"
#: What the tables of a segment hold.
SHAPES = {"postings": PACKED_SHAPE, "rows": "key string, dl long, part long, at int", "void": "key string"}


# Blocks


def packed(strings: pa.Array, *numbers: np.ndarray) -> bytes:
    """Strings and lists of whole numbers (of 32 bits): the bytes of each size together, since most of the upper ones are zero."""
    size = pc.binary_length(strings).to_numpy(zero_copy_only=False)
    text = b"".join(s.encode() for s in strings.to_pylist())
    body = text + b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in (size, *numbers))
    head = np.array([len(body), len(text), len(size), *map(len, numbers)], "<u4")
    return bytes([len(head)]) + head.tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpacked(block: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    n = block[0]
    raw, text, *sizes = np.frombuffer(block, "<u4", n, 1).tolist()
    body = pa.decompress(block[1 + 4 * n :], raw, "zstd", asbytes=True)
    at, out = text, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(size).astype(np.int64))
        at += 4 * size
    ends = np.concatenate([[0], np.cumsum(out[0])]).astype(np.int32)
    return pa.StringArray.from_buffers(len(out[0]), pa.py_buffer(ends), pa.py_buffer(body[:text])), out[1:]


def _since(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each value less the one before it, but where new."""
    before = np.concatenate([values[:1], values[:-1]])
    return np.where(new, values, values - before)


def _restored(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of runs (of these sizes) from _since."""
    if not len(steps):
        return steps
    whole, first = np.cumsum(steps), np.cumsum(size) - size
    return whole - np.repeat(whole[first] - steps[first], size)


def _block(names: pa.Array, field: np.ndarray, n: np.ndarray, row: np.ndarray, places: np.ndarray, place: np.ndarray) -> bytes:
    """Postings of terms (names, each in a field): n of each, of ascending rows; places of each posting, ascending."""
    first = np.zeros(len(row), bool)
    first[np.cumsum(n) - n] = True
    begins = np.zeros(len(place), bool)
    begins[np.cumsum(places) - places] = True
    return packed(names, field, n, _since(row, first), places - 1, _since(place, begins))


def _postings_of(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """names, field, n, row, places, place: as they went into _block."""
    names, (field, n, steps, more, place) = unpacked(block)
    return names, field, n, _restored(steps, n), more + 1, _restored(place, more + 1)


def _blocks(part: int, field: np.ndarray, row: np.ndarray, place: np.ndarray, code: np.ndarray, names: pa.Array, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, bucket, block) of tokens (their places in names), which come by row and place within a field."""
    if not len(row):
        return
    bucket_of = np.array([zlib.crc32(w.encode()) % buckets for w in names.to_pylist()], np.int64)
    name_at = np.empty(len(names), np.int64)
    name_at[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    each, of = np.unique(field * len(names) + code, return_inverse=True)
    term, inside = each % len(names), each // len(names)
    order = np.lexsort((name_at[term], inside, bucket_of[term]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term, inside, bucket = term[order], inside[order], bucket_of[term[order]]
    of = rank[of]
    move = np.argsort(of, kind="stable")
    of, row, place = of[move], row[move], place[move]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (row[1:] != row[:-1])]))
    n = np.bincount(of[first], minlength=len(term))
    ends, places = np.concatenate([[0], np.cumsum(n)]), np.diff(np.append(first, len(row)))
    first = np.append(first, len(row))
    sorted_names = names.take(pa.array(term))
    cut = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        p, q = ends[a], ends[b]
        yield part, int(bucket[a]), _block(sorted_names.slice(a, b - a), inside[a:b], n[a:b], row[first[p:q]], places[p:q], place[first[p] : first[q]])


def _rows_block(part: int, keys: pa.Array, dl: np.ndarray) -> tuple[int, int, bytes]:
    return part, ROWS, packed(pc.fill_null(keys, ""), pc.is_valid(keys).to_numpy(zero_copy_only=False), dl)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)


def gathered(found: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """part, bucket, block of the rows and of each distinct term of their columns, gathered where the rows are read. found: as from
    lexical.index, with texts or with tokens; the tokens of a column whose name begins with + stand for what their stem is indexed as."""
    texts = "dl" not in found.columns
    read = [c for c in columns if not texts or not c.startswith("+")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meaning, memo = lexical.stem_meaning(), {}

        def stands_for(word: str) -> str:
            if len(memo) > 1 << 17:
                memo.clear()
            if word not in memo:
                memo[word] = meaning(word)
            return memo[word]

        def cut(column: pa.Array, stems: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            if texts and not stems:
                return scan.tokens(column, scan.folded, X.TOKEN)
            if texts:
                row, code, words = scan.tokens(column, scan.lowered, X.TERM)
                means = [[stands_for("_" + p) for p in w.split("_") if p] if "_" in w else [stands_for(w)] for w in words.to_pylist()]
                each = pc.dictionary_encode(pa.array([m for some in means for m in some], pa.string()))
                first = np.concatenate([[0], np.cumsum([len(m) for m in means])]).astype(np.int64)
                i, code = scan.expand(first, each.indices.to_numpy(zero_copy_only=False).astype(np.int64), code)
                return row[i], code, each.dictionary
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            each = pc.dictionary_encode(column.flatten())
            names = pa.array([stands_for(w) for w in each.dictionary.to_pylist()], pa.string()) if stems else each.dictionary
            return np.repeat(np.arange(len(size)), size), each.indices.to_numpy(zero_copy_only=False).astype(np.int64), names

        def made(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            column = dict(zip(read, b.columns[1 if texts else 2 :], strict=True))
            length, out, names = np.zeros(b.num_rows, np.int64), [], []
            for k, c in enumerate(columns):
                row, code, words = cut(column[c.removeprefix("+") if texts else c], c.startswith("+"))
                size = np.bincount(row, minlength=b.num_rows)
                length += size
                out.append((np.full(len(row), k, np.int64), row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), code + sum(map(len, names))))
                names.append(words)
            each = pc.dictionary_encode(pa.concat_arrays(names))
            field, row, place, code = (np.concatenate(x) for x in zip(*out, strict=True))
            code = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else code
            return _batch([_rows_block(part, b.column(0), length), *_blocks(part, field, row, place, code, each.dictionary, buckets)], PACKED)

        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= PART:
                yield made(part, held)
                part, held, size = part + 1, [], 0
        if any(b.num_rows for b in held):
            yield made(part, held)

    return scan.arrow_map(found.select("key", *([] if texts else ["dl"]), *[F.col(f"`{c}`") for c in read]), run, PACKED_SHAPE)


def _rows_of(block: bytes) -> tuple[pa.Array, np.ndarray]:
    keys, (known, dl) = unpacked(block)
    return pc.if_else(pa.array(known == 1), keys, pa.scalar(None, pa.string())), dl


def row_table(blocks: DataFrame) -> DataFrame:
    """key, dl, part, at (its place in the part) of each row in packed blocks."""
    schema = pa.schema([("key", pa.string()), ("dl", pa.int64()), ("part", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, dl = _rows_of(block.as_py())
                yield pa.RecordBatch.from_arrays([keys, pa.array(dl), pa.repeat(pa.scalar(part, pa.int64()), len(dl)), pa.array(np.arange(len(dl), dtype=np.int32))], schema=schema)

    return scan.arrow_map(blocks.filter(F.col("bucket") == ROWS).select("part", "block"), run, SHAPES["rows"])


def _live_at(rows: pa.Table, names: list[str]) -> dict[tuple, np.ndarray]:
    """By part (the columns names): the place among rows of each place in the part, or -1."""
    whose = list(zip(*[rows[c].to_pylist() for c in names], strict=True))
    at, out = rows["at"].to_numpy(), {}
    by: dict[tuple, list[int]] = {}
    for k, w in enumerate(whose):
        by.setdefault(w, []).append(k)
    for w, own in by.items():
        places = at[own]
        out[w] = np.full(int(places.max()) + 1, -1, np.int64)
        out[w][places] = own
    return out


def _of_live(row: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    if live is None:
        return np.full(len(row), -1, np.int64)
    return np.where(row < len(live), live[np.minimum(row, len(live) - 1)], -1)


class Arms:
    """Finds arms (side, tokens) in blocks. fields: the name of each field's number."""

    def __init__(self, arms: list[tuple[str, list[str]]], fields: list[str], weights: dict[str, float]) -> None:
        self.n, self.size = len(arms), np.array([len(tokens) for _, tokens in arms], np.int64)
        self.side = np.array([f.startswith("+") for f in fields], bool)
        self.weight = np.array([weights.get(f, 0.0) for f in fields])
        self.asked = np.array([f in weights for f in fields], bool)
        where: dict[str, dict[str, list[tuple[int, int]]]] = {"": {}, "+": {}}
        for k, (side, tokens) in enumerate(arms):
            for offset, token in enumerate(tokens):
                where[side].setdefault(token, []).append((k, offset))
        self.names = [pa.array(list(where[s]), pa.string()) for s in ("", "+")]
        found = [x for s in ("", "+") for x in where[s].values()]
        self.first, self.arm = scan.spread([[k for k, _ in x] for x in found])
        self.offset = np.array([o for x in found for _, o in x], np.int64)

    def words(self, names: pa.Array, field: np.ndarray) -> np.ndarray:
        """The asked token that each term is, or -1."""
        plain, stem = (pc.fill_null(pc.index_in(names, value_set=v), -1).to_numpy(zero_copy_only=False).astype(np.int64) for v in self.names)
        stem = np.where(stem >= 0, stem + len(self.names[0]), -1)
        return np.where(self.asked[field], np.where(self.side[field], stem, plain), -1)

    def cut(self, block: bytes) -> bytes | None:
        """The block of what is asked for."""
        names, field, n, row, places, place = _postings_of(block)
        some = self.words(names, field) >= 0
        if not some.any():
            return None
        of = np.repeat(some, n)
        return _block(names.filter(pa.array(some)), field[some], n[some], row[of], places[of], place[np.repeat(of, places)])

    def found(self, blocks: list[bytes], live: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, arm, f), by row and arm, of the rows that live has, by its numbers."""
        got = []
        for block in blocks:
            names, field, n, row, places, place = _postings_of(block)
            term = np.repeat(np.repeat(np.arange(len(names)), n), places)
            row = _of_live(np.repeat(row, places), live)
            word = self.words(names, field)[term]
            ok = (word >= 0) & (row >= 0)
            got.append((field[term[ok]], row[ok], word[ok], place[ok]))
        field, row, word, place = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 4
        i, k = scan.expand(self.first, np.arange(len(self.arm)), word)
        arm, start = self.arm[k], place[i] - self.offset[k]
        cell = (field[i] * rows + row[i]) * self.n + arm
        one = self.size[arm] == 1
        long = ~one & (start >= 0)
        wide = int(start.max(initial=0)) + 1
        at, n = np.unique(cell[long] * wide + start[long], return_counts=True)
        at = at[n == self.size[at // wide % self.n]] // wide  # the whole phrase stands there
        cell, n = np.unique(np.concatenate([cell[one], at]), return_counts=True)
        where, back = np.unique(cell % (rows * self.n), return_inverse=True)
        f = np.bincount(back, self.weight[cell // (rows * self.n)] * n, len(where))
        return where // self.n, where % self.n, f


class Index:
    """The index under root of rows with these fields, and with the stems of their words if stemmed."""

    def __init__(self, spark: SparkSession, root: str, fields: list[str], stemmed: bool = True, buckets: int = BUCKETS) -> None:
        self.spark, self.fields, self.stemmed, self.buckets = spark, list(fields), stemmed, buckets
        self.columns = [*self.fields, *[f"+{f}" for f in self.fields if stemmed]]
        self.versions = Snapshots(spark, root)

    def serves(self, weights: dict[str, float], stemmed: bool) -> bool:
        """Whether scores with these weights can come from here: lengths are those of all fields, and of the stems."""
        return sorted(weights) == sorted(self.fields) and stemmed == self.stemmed

    # Segments

    def _tables(self, kind: str, at: str | None = None) -> dict[int, str]:
        at = at or self.versions.current()
        names = self.versions.manifest(at)["tables"] if at else {}
        return {int(n.rsplit("-", 1)[1]): n for n in sorted(names) if n.startswith(f"{kind}-")}

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def _dealt(self, blocks: DataFrame) -> DataFrame:
        """The blocks of terms by bucket; a bucket with much in it is dealt over several tasks."""
        return blocks.filter(F.col("bucket") != ROWS).hint("rebalance", "bucket").sortWithinPartitions("bucket", "part")

    def _postings(self, found: DataFrame) -> DataFrame:
        """key, dl, field, term, at (its places, ascending), bucket: what the blocks of found hold, one by one. found: as from lexical.index."""
        columns = self.columns
        blocks = written(gathered(found, columns, self.buckets), "packed")

        def run(terms: pa.Table, rows: pa.Table) -> pa.Table:
            keys, dl = _rows_of(rows["block"][0].as_py())
            out = []
            for bucket, block in zip(terms["bucket"].to_pylist(), terms["block"].to_pylist(), strict=True):
                names, field, n, row, places, place = _postings_of(block)
                term, end = np.repeat(np.arange(len(names)), n), np.cumsum(places)
                at = [place[e - p : e].tolist() for e, p in zip(end, places, strict=True)]
                out += zip(keys.take(pa.array(row)).to_pylist(), dl[row].tolist(), [columns[f] for f in field[term]], names.take(pa.array(term)).to_pylist(), at, [bucket] * len(row), strict=True)
            schema = pa.schema([("key", pa.string()), ("dl", pa.int64()), ("field", pa.string()), ("term", pa.string()), ("at", pa.list_(pa.int32())), ("bucket", pa.int32())])
            return pa.Table.from_batches([_batch(out, schema)])

        rows = blocks.filter(F.col("bucket") == ROWS)
        return self._dealt(blocks).groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(run, "key string, dl long, field string, term string, at array<int>, bucket int")

    def update(self, rows: DataFrame | None = None, void: DataFrame | None = None, key: str = "anchor", note: dict | None = None) -> str:
        """Bring rows in, in place of those with the same key, and take the keys of void (key) out: one segment, one version."""
        gone = None if void is None else void.select(F.col("key").cast("string").alias("key"))
        if rows is None:
            return self._publish(None, gone, note)
        found = lexical.index(rows.withColumn(key, F.col(key).cast("string")), self.fields, self.stemmed, key, keep=False)
        with held_for(gathered(found, self.columns, self.buckets), "packed") as blocks:
            brought = row_table(blocks).select("key")
            return self._publish(blocks, brought if gone is None else gone.unionByName(brought), note)

    def _publish(self, blocks: DataFrame | None, gone: DataFrame | None, note: dict | None) -> str:
        while True:
            base = self.versions.current()
            last = max([0, *self._tables("rows", base), *self._tables("void", base)])
            tables, old = {}, [*self._tables("postings", base).values(), *self._tables("rows", base).values(), *self._tables("void", base).values()]
            name = f"{last + 1:06d}"
            if blocks is not None:
                tables |= {f"postings-{name}": self._dealt(blocks), f"rows-{name}": row_table(blocks)}
            if gone is not None and base:
                tables[f"void-{name}"] = gone.distinct()
            try:
                return self.versions.publish(tables, keep=old, base=base, partitions={f"postings-{name}": ["bucket"]}, note=note)
            except Conflict:
                continue

    def _live(self, rows: DataFrame, at: str) -> DataFrame:
        """rows (key, segment, ...) without those that a later segment made void."""
        void = None
        for n, name in self._tables("void", at).items():
            one = self.versions.read(name, at, SHAPES["void"]).select("key", F.lit(n).alias("_by"))
            void = one if void is None else void.unionByName(one)
        if void is None:
            return rows
        by = void.groupBy("key").agg(F.max("_by").alias("_by"))
        return rows.join(by, "key", "left").filter(F.col("_by").isNull() | (F.col("_by") <= F.col("segment"))).drop("_by")

    def _all(self, kind: str, at: str, where: Column | None = None) -> DataFrame:
        out = None
        for n, name in self._tables(kind, at).items():
            one = self.versions.read(name, at, SHAPES[kind])
            one = (one if where is None else one.filter(where)).withColumn("segment", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def compact(self) -> str:
        """One segment of what is live, in place of all."""
        while True:
            at = self.versions.current()
            n = max(self._tables("rows", at)) + 1
            name = f"{n:06d}"
            live = written(self._live(self._all("rows", at), at), "live")
            groups = max(1, -(-(live.agg(F.sum("dl")).first()[0] or 0) // TOKENS))
            with held_for(self._merged(self._all("postings", at), live, groups), "packed") as blocks:
                try:
                    return self.versions.publish({f"postings-{name}": self._dealt(blocks), f"rows-{name}": row_table(blocks)}, base=at, partitions={f"postings-{name}": ["bucket"]}, note=self.note())
                except Conflict:
                    continue

    def _merged(self, blocks: DataFrame, live: DataFrame, groups: int) -> DataFrame:
        """part, bucket, block: the live rows of several parts as one."""
        buckets = self.buckets

        def run(own: pa.Table, rows: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.Table.from_batches([], PACKED)
            rows = rows.sort_by([("segment", "ascending"), ("part", "ascending"), ("at", "ascending")])
            at, got, names = _live_at(rows, ["segment", "part"]), [], [pa.array([], pa.string())]
            for segment, part, block in zip(own["segment"].to_pylist(), own["part"].to_pylist(), own["block"].to_pylist(), strict=True):
                words, field, n, row, places, place = _postings_of(block)
                term = np.repeat(np.repeat(np.arange(len(words)), n), places)
                row = _of_live(np.repeat(row, places), at.get((segment, part)))
                ok = row >= 0
                got.append((field[term[ok]], row[ok], place[ok], term[ok] + sum(map(len, names))))
                names.append(words)
            field, row, place, code = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 4
            each = pc.dictionary_encode(pa.concat_arrays(names))
            order = np.lexsort((place, row))
            code = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else code
            part = rows["group"][0].as_py()
            out = [_rows_block(part, rows["key"].combine_chunks(), rows["dl"].to_numpy()), *_blocks(part, field[order], row[order], place[order], code[order], each.dictionary, buckets)]
            return pa.Table.from_batches([_batch(out, PACKED)])

        dealt = lambda t: t.withColumn("group", F.pmod(F.xxhash64("segment", "part"), F.lit(groups))).groupBy("group")
        return dealt(blocks).cogroup(dealt(live)).applyInArrow(run, PACKED_SHAPE)

    def note(self) -> dict:
        """What the last update said of itself."""
        at = self.versions.current()
        return (self.versions.manifest(at).get("note") or {}) if at else {}

    # Search

    def matches(self, arms: DataFrame, weights: dict[str, float] | None = None, live: DataFrame | None = None) -> DataFrame:
        """key, dl, arms, f: as from scan.hits, of live rows that hold one of the arms, which count in their order by name. arms: as
        from lexical.arms, of a block of queries; live: the live rows, if they are known."""
        distinct = {r[0]: (r[1], list(r[2])) for r in arms.select("arm", "side", "tokens").dropDuplicates(["arm"]).collect()}  # a block's
        return self._matches([distinct[a] for a in sorted(distinct)], weights or dict.fromkeys(self.columns, 1.0), live)

    def _matches(self, wanted: list[tuple[str, list[str]]], weights: dict[str, float], live: DataFrame | None = None) -> DataFrame:
        at = self.versions.current()
        live = self._live(self._all("rows", at), at) if live is None else live
        asked, columns = sorted({zlib.crc32(t.encode()) % self.buckets for _, tokens in wanted for t in tokens}), self.columns
        schema = pa.schema([("key", pa.string()), ("dl", pa.int64()), ("arms", pa.list_(pa.int32())), ("f", pa.list_(pa.float64()))])
        some = pa.schema([("segment", pa.int32()), ("part", pa.int64()), ("block", pa.binary())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arms = Arms(wanted, columns, weights)
            for b in batches:
                found = [(s, p, arms.cut(x)) for s, p, x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
                yield _batch([r for r in found if r[2]], some)

        made: list[Arms] = []

        def meet(blocks: pa.Table, rows: pa.Table) -> pa.Table:
            if not blocks.num_rows or not rows.num_rows:
                return pa.Table.from_batches([], schema)
            if not made:
                made.append(Arms(wanted, columns, weights))
            keys, dl = rows["key"].combine_chunks(), rows["dl"].to_numpy()
            places = rows["at"].to_numpy()
            alive = np.full(int(places.max()) + 1, -1, np.int64)
            alive[places] = np.where(pc.is_valid(keys).to_numpy(zero_copy_only=False), np.arange(len(places)), -1)
            row, arm, f = made[0].found(blocks["block"].to_pylist(), alive, len(places))
            own, first = np.unique(row, return_index=True)
            ends = pa.array(np.append(first, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (arm.astype(np.int32), f)]
            return pa.Table.from_arrays([keys.take(pa.array(own)), pa.array(dl[own]), *lists], schema=schema)

        held = self._all("postings", at, F.col("bucket").isin(asked)).select("segment", "part", "block")
        held = scan.arrow_map(held, cut, "segment int, part long, block binary")
        rows = live.select("segment", "part", "at", "key", "dl")
        return held.groupBy("segment", "part").cogroup(rows.groupBy("segment", "part")).applyInArrow(meet, "key string, dl long, arms array<int>, f array<double>")

    def scorer(self, queries: DataFrame, weights: dict[str, float], mode: str = "any") -> lexical.Scorer:
        """As lexical.scorer over all live rows; beginnings of words aren't looked up here."""
        if mode not in ("any", "all"):
            raise ValueError(f"the index has no mode {mode}")
        if not self.serves(weights, self.stemmed):
            raise ValueError(f"the index is of {self.fields}")
        arms, at = written(lexical.arms(queries, self.stemmed), "arms"), self.versions.current()
        live = written(self._live(self._all("rows", at), at), "live")
        stats = live.agg(F.count("*").alias("rows"), F.avg("dl").alias("avgdl"))
        blocks = [lexical.block_of(some, weights, self.stemmed, lambda wanted, every: self._matches(wanted, every, live)) for some in scan.blocks(arms, "query_id")]
        return lexical.Scorer(arms, None, stats, self.stemmed, mode, blocks)

    def bm25(self, queries: DataFrame, weights: dict[str, float], limit: int, keep: DataFrame | None = None, mode: str = "any", key: str = "anchor") -> DataFrame:
        """query_id, key, score, rank: as lexical.bm25. keep: key of the rows that may be candidates."""
        return lexical.top(self.scorer(queries, weights, mode).best(limit, keep).withColumnRenamed("key", key), limit, key)
