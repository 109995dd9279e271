"""Line dedup by winnowing.

A document is its lines, cut at line feeds. A run of ``min_run`` or more consecutive lines that also stands earlier
(in a document with a smaller id, or earlier in the same one) is deleted.

Every ``gram`` consecutive lines have a hash; of each window of min_run - gram + 1 such hashes the minimum is a
fingerprint. Two equal runs of min_run lines hold the same fingerprint, so a run can repeat only where a
fingerprint does. Fingerprints are counted; the positions of those that occur twice or more come back by a join, and
each is extended both ways into the runs of min_run lines that hold it. Of equal runs the first is found by a
grouping, all others are deleted, and the runs of a document overlap into its maximal deleted runs. Nothing is
paired, so a run that a third of all documents share costs a row for each of them.

With ``words``, shorter runs (single lines, pairs) count too if all their lines have a word and they have so many
words together; each is a fingerprint and a run of its own. Runs are written as position * min_run + length, with
length 0 for min_run.

Only hashes move before the last step: 64 bits for a fingerprint, 128 for a run, from 128 bits of each of its lines.
Texts are deleted by those 128 bits without being compared.

Defined results: a null or empty text has one empty line at most and stays as it is. Rows that share a doc_id count
as one document with several texts: none of them is earlier than another at the same line. A null doc_id comes last.
Documents of fewer than min_run lines are untouched without ``words``. Columns besides id and text pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, as_bytes, batch, id_key, materialize, settled

MIN_RUN = 3
GRAM = 2
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each value mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, base: np.uint64 = _B1) -> np.ndarray:
    """A hash of each n consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * base + h[k : k + len(out)]
    return mixed(out)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The positions that hold the minimum of some w consecutive values, all of equal minima."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(pad, w).max(axis=1) == g)


def line_hashes(text: bytes) -> np.ndarray:
    """128 bits of each line, as two columns."""
    lines = text.split(b"\n")
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.uint64).reshape(-1, 2)


def word_counts(text: bytes, most: int) -> np.ndarray:
    """The words of each line, counted as far as most + 1."""
    lines = text.split(b"\n")
    return np.fromiter((len(x.split(None, most)) for x in lines), np.uint8, len(lines))


def short_runs(counts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Where n consecutive lines that each have a word have ``words`` or more together."""
    if len(counts) < n:
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(counts, n)
    return np.flatnonzero((w.sum(axis=1) >= words) & (w.min(axis=1) > 0))


def hashed(docs: DataFrame, id_col: str, text_col: str, words: int | None = None) -> DataFrame:
    """id, version, hashes of the lines of each document that has some, words of each line (empty unless asked);
    version tells texts of one id apart."""
    schema = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("lines", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            counts = [b"" if words is None else word_counts(t, words).tobytes() for t in texts]
            yield batch(schema, b.column(0), b.column(1), [line_hashes(t).tobytes() for t in texts], counts)

    rows = docs.filter(F.col(text_col) != "").select(id_key(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string"))
    return rows.transform(arrow_map, run, "id long, version long, lines binary, words binary").dropDuplicates(["id", "version"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """id, version, lines (array<int>, ascending): the lines to delete of each document that has any."""
    if not 1 <= gram <= min_run:
        raise ValueError("gram is between 1 and min_run")
    if words is not None and not 1 <= words < 255:
        raise ValueError("words is between 1 and 254")
    shorter = range(1, min_run) if words is not None else ()
    lines = materialize(hashed(docs, id_col, text_col, words), "line-hashes")
    marks = pa.schema([("fp", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32())])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v, data, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, counts = np.frombuffer(data, np.uint64)[::2], np.frombuffer(counts, np.uint8)
                g = grams(h, gram)
                at = winnow(g, min_run - gram + 1)
                fp, at = [g[at]], [at * min_run]
                for n in shorter:
                    p = short_runs(counts, n, words)
                    fp.append(mixed(grams(h, n)[p] + np.uint64(n)))
                    at.append(p * min_run + n)
                fp, at = np.concatenate(fp), np.concatenate(at)
                if len(at):
                    yield batch(marks, fp.view(np.int64), [i] * len(at), [v] * len(at), at.astype(np.int32))

    found = materialize(lines.transform(arrow_map, coalesced(fingerprints, marks), "fp long, id long, version long, pos int"), "line-marks")
    # written, so that both sides of the join are plain exchanges and Spark splits the rows of a common fingerprint
    twice = materialize(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "line-marks-twice")
    # a document's own fingerprints are at most as many as its lines
    held = found.join(twice, "fp").groupBy("id", "version").agg(F.collect_list("pos").alias("at"))
    runs_schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v, data, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, second = np.frombuffer(data, np.uint64).reshape(-1, 2).T
                at = np.array(at, np.int64)
                for n in (min_run, *shorter):
                    starts = at[at % min_run == n % min_run] // min_run
                    if n == min_run:
                        starts = np.unique(np.add.outer(starts, np.arange(gram - min_run, 1)))
                        starts = starts[(starts >= 0) & (starts <= len(h) - min_run)]
                    if len(starts):
                        run = (starts * min_run + n % min_run).astype(np.int32)
                        yield batch(runs_schema, grams(h, n)[starts].view(np.int64), grams(second, n, _B2)[starts].view(np.int64), [i] * len(starts), [v] * len(starts), run)

    runs = lines.join(held, ["id", "version"]).select("id", "version", "lines", "at").transform(arrow_map, coalesced(extend, runs_schema), "h1 long, h2 long, id long, version long, pos int")
    runs = materialize(runs, "line-runs")
    first = materialize(runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).filter("n > 1"), "line-runs-first")
    later = runs.join(first, ["h1", "h2"]).filter(F.struct("id", "pos") > F.col("first"))
    covered = later.groupBy("id", "version").agg(F.collect_list("pos").alias("starts"))
    begin, length = (lambda s: F.floor(s / min_run).cast("int")), (lambda s: F.when(s % min_run == 0, min_run).otherwise(s % min_run))
    reach = F.flatten(F.transform("starts", lambda s: F.sequence(begin(s), begin(s) + length(s) - 1)))
    return covered.select("id", "version", F.array_sort(F.array_distinct(reach)).alias("lines"))


def coalesced(rows, schema: pa.Schema, size: int = 1 << 16):
    """rows with its small batches joined into larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in rows(batches):
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return run


def _without():
    @F.arrow_udf("string")
    def without(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(as_bytes(texts), drops.to_pylist(), strict=True):
            if text is not None:
                gone = set(drop)
                text = b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in gone])
            out.append(text)
        return pa.array(out, pa.binary()).cast(pa.string())

    return without


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, gram: int = GRAM, removed_as: str | None = None, keep_emptied: bool = True, words: int | None = None) -> DataFrame:
    """docs with the repeated runs deleted from the text; removed_as: a column for the number of lines deleted;
    keep_emptied: whether documents that lose all their lines stay, with an empty text; words: of shorter runs that count."""
    names, own = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    i, t = own[names.index(id_col)], own[names.index(text_col)]
    drop = settled(lambda: repeated_lines(docs, id_col, text_col, min_run, gram, words), "repeated-lines").withColumnsRenamed({"id": "_id", "version": "_version", "lines": "_drop"}).hint("merge")  # one plan at every size
    rows = docs.toDF(*own).withColumn("_id", id_key(i)).withColumn("_version", F.xxhash64(t)).join(drop, ["_id", "_version"], "left")
    # only the texts that lose lines go through Python
    text = F.when(F.col("_drop").isNull(), F.col(t)).otherwise(_without()(F.when(F.col("_drop").isNotNull(), F.col(t)), F.col("_drop")))
    out = [text.alias(o) if o == t else F.col(o) for o in own]
    got = rows.select(*out, F.coalesce(F.size("_drop"), F.lit(0)).alias("_n"))
    if not keep_emptied:
        got = got.filter((F.col("_n") == 0) | (F.col(t) != ""))
    return got.toDF(*names, removed_as) if removed_as else got.drop("_n").toDF(*names)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, removed_as="n_removed").select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
