"""Spelling variants: words at edit distance one, the form that each is a variant of, and the root it leads to.

Symmetric-delete join: every word emits a key for itself and one for each of its distinct single deletions; words that
share a key are candidates, and those at a distance of exactly one are near. Words at distance one always share a key: of
an insertion, the shorter word is the longer one's deletion; of a replacement, both lack the same code point. Keys are
64-bit polynomial hashes, so a word of n code points emits its n + 1 keys in time and space proportional to n, and what
a key's collision brings together the check of the distance drops. Words that share a key are the key itself or have one
code point more, so for a script of c letters and a key of k they are at most (k + 1) * c + 1, however large the corpus.

Defined results: a null text has no words; a null doc_id is written as an empty string in the damage rule; rows that
repeat a doc_id count as often as they stand there. An empty table gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map, batch, long_lists, materialize, remove, settled, store

#: A run of letters.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a word at least, and its occurrences.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs so many times as often as its variant.
FACTOR = 5
#: One run in so many of a document loses a code point.
DAMAGE = 199

#: An odd number, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, or, if DAMAGE divides the CRC-32 of doc_id:run, the run without the code point at CRC % length."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of MIN_LENGTH code points and MIN_COUNT occurrences. Counted where they are read before they move."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= MIN_LENGTH)).alias("run"))
    found = runs.select(damaged(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def keys_of(code_points: np.ndarray) -> np.ndarray:
    """The distinct hashes of the word and of its single deletions; the word's own comes first."""
    n = len(code_points)
    power = np.ones(n, np.uint64)
    np.cumprod(np.full(max(0, n - 1), BASE, np.uint64), out=power[1:])
    term = (code_points.astype(np.uint64) + np.uint64(1)) * power
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    deletions = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(INVERSE)  # what stands behind moves one place forward
    # the length keeps a word apart from what ends in the code point that counts as zero
    own = mixed(upto[-1:], n)
    return np.concatenate([own, np.setdiff1d(mixed(deletions, n - 1), own)])


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = h ^ np.uint64(length * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def keyed(table: DataFrame) -> DataFrame:
    """id, length, keys (array<long>) of rows (id, word): the word's own key first, then those of its deletions."""
    schema = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in part.column(1).to_pylist()]
                found = [keys_of(p) for p in points]
                yield batch(schema, part.column(0), list(map(len, points)), long_lists(np.concatenate(found).view(np.int64), np.array([len(k) for k in found]), pa.int64()))

    return table.select("id", "word").transform(arrow_map, run, "id long, length long, keys array<long>")


def moved(table: DataFrame) -> DataFrame:
    """table, which is shuffled to what it is joined with: tables of words grow with the corpus, however few bytes they take
    when compressed, and a broadcast would hold them whole in the driver."""
    return table.hint("merge")


def near_pairs(table: DataFrame) -> DataFrame:
    """word, other, other_n: all ordered pairs of near words of the table (word, n). Keys move with numbers of the words,
    and words meet only where two of them have met at a key."""
    numbered = materialize(table.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered")
    own = keyed(numbered).select("id", "length", F.posexplode("keys").alias("pos", "key"))
    left = own.select("id", "length", "key", (F.col("pos") == 0).alias("whole"))
    right = own.select(F.col("id").alias("other_id"), F.col("length").alias("other_length"), "key", (F.col("pos") == 0).alias("other_whole"))
    # an insertion meets at the shorter word's own key, a replacement at a deletion of both
    alike = (F.col("whole") != F.col("other_whole")) | (~F.col("whole") & ~F.col("other_whole") & (F.col("length") == F.col("other_length")))
    met = left.join(moved(right), "key").filter(alike & (F.col("id") != F.col("other_id"))).select("id", "other_id").distinct()
    others = numbered.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return met.join(moved(numbered.select("id", "word")), "id").join(moved(others), "other_id").select("word", "other", "other_n").transform(arrow_map, verified, "word string, other string, other_n long")


def one_apart(a: str, b: str) -> bool:
    """Whether one code point is inserted, deleted or replaced, in time proportional to the words' length."""
    a, b = sorted((a, b), key=len)
    k = len(os.path.commonprefix([a, b]))
    return len(b) - len(a) <= 1 and a != b and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (word, other, ...) whose words are one apart."""
    for b in batches:
        yield b.filter(pa.array(map(one_apart, b.column(0).to_pylist(), b.column(1).to_pylist()), pa.bool_()))


def variants(table: DataFrame) -> DataFrame:
    """word, n, form, form_n, n_near, root of the table (word, n): the form is the near word of largest n, the smallest of
    equals, if it occurs FACTOR times as often. Roots are found by doubling: n grows by FACTOR with each form, so a chain
    has at most log n links and log log n rounds follow it."""
    spark = table.sparkSession
    table = materialize(table, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other"))  # strings compare in code-point order
    near = near_pairs(table).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus_n") >= FACTOR * F.col("n")
    forms = table.join(moved(near), "word", "left").select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.minus_n")).alias("form_n"))
    forms = materialize(forms, "forms")
    at = store(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        roots = spark.read.parquet(at)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = store(roots.join(moved(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(spark, at)
        at = longer
        if spark.read.parquet(at).filter("moved").isEmpty():
            break
    roots = spark.read.parquet(at).select("word", "root")
    return forms.join(moved(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "spelling")
