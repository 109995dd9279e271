"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled training row (no sample); each task sends one row for each feature and
language it met. The log-probability matrix has 2**bits entries for each of at most ``most_langs`` languages, so its
size has a bound (64 MB by default), and it is broadcast. Scoring is sparse: the entries of the matrix that a batch of
texts touches are gathered and summed by text in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
learnt. The score is the posterior probability of the predicted language. Ties go to the language first by code
point. A null doc_id is not held out and not learnt from. Empty tables give an empty result. Language, source and id
are never inputs of a prediction; other columns are not read, or passed through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import arrow_map

UND = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Shape:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    alpha: float = 0.5
    #: Characters looked at in one go; bounds memory, not what is read.
    piece: int = 1 << 20


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray  # (languages, 2**bits)
    shape: Shape


def features(text: str, shape: Shape) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, padded by spaces, in pieces that overlap so that none is lost."""
    text = f" {text.lower()} "
    widest = max(shape.orders)
    for at in range(0, len(text), shape.piece):
        c = np.frombuffer(text[at : at + shape.piece + widest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, widest + 1):
            m = min(len(c) - n + 1, shape.piece)
            if m <= 0:
                break
            h = (h[:m] ^ c[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in shape.orders:
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - shape.bits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_langs: int = 128) -> Model:
    """Learns from every labelled row that is not held out; more than ``most_langs`` languages raise."""
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    schema = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang], docs_of[lang] = np.zeros(1 << shape.bits, np.int64), 0
                docs_of[lang] += 1
                for f in features(text, shape):
                    np.add.at(seen[lang], f, 1)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], docs_of[lang]), pa.int64())], schema=schema)

    counted = rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).transform(arrow_map, count, "lang string, feature int, n long")
    dense = pa.schema([("lang", pa.string()), ("counts", pa.binary()), ("docs", pa.int64())])

    def packed(table: pa.Table) -> pa.Table:
        f, n = table.column("feature").to_numpy(), table.column("n").to_numpy()
        counts = np.zeros(1 << shape.bits, np.int64)
        counts[f[f >= 0]] = n[f >= 0]
        return pa.table([[table.column("lang")[0].as_py()], [counts.tobytes()], [int(n[f < 0].sum())]], schema=dense)

    # a row for each language; whatever the number of documents, the driver gets most_langs rows at most
    totals = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(packed, "lang string, counts binary, docs long")
    got = sorted(totals.limit(most_langs + 1).collect(), key=lambda r: r.lang)
    if len(got) > most_langs:
        raise ValueError(f"more than {most_langs} languages; a matrix for each needs {8 << shape.bits} bytes on every worker")
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in got], np.float64).reshape(-1, 1 << shape.bits)
    n_docs = np.array([r.docs for r in got], np.float64)
    prob = np.log(counts + shape.alpha) - np.log(counts.sum(axis=1, keepdims=True) + shape.alpha * (1 << shape.bits))
    return Model(tuple(r.lang for r in got), np.log(np.maximum(n_docs, 1) / max(1, n_docs.sum())), prob, shape)


def score(texts: list[str | None], model: Model, lot: int = 1 << 20) -> tuple[list[str], list[float]]:
    """The language and its posterior of each text. The n-grams of many texts make one sparse batch of about ``lot``:
    for each language their entries of the matrix are gathered at once and summed by text."""
    total = np.tile(model.prior.astype(np.float64), (len(texts), 1))
    known = np.array([bool(model.langs and t and _LETTER.search(t)) for t in texts], bool)
    held: list[np.ndarray] = []
    of: list[int] = []

    def add() -> None:
        flat, starts = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
        for k in range(len(model.langs)):
            np.add.at(total[:, k], of, np.add.reduceat(model.log_prob[k].take(flat), starts))
        held.clear()
        of.clear()

    size = 0
    for i in np.flatnonzero(known).tolist():
        for f in features(texts[i], model.shape):
            if len(f):
                held.append(f)
                of.append(i)
                size += len(f)
        if size >= lot:
            add()
            size = 0
    if held:
        add()
    if not model.langs:
        return [UND] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, p, 0.0).tolist()


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the two columns added; the other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{o} {f.dataType.simpleString()}" for o, f in zip(own, docs.schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [score(b.column(at).slice(k, 512).cast(pa.string()).to_pylist(), shared.value) for k in range(0, b.num_rows, 512)]
            langs, scores = [x for g in got for x in g[0]], [x for g in got for x in g[1]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "_lang", "_score"])

    return docs.toDF(*own).transform(arrow_map, run, f"{kinds}, _lang string, _score double").toDF(*docs.columns, lang_as, score_as)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is identified with a posterior of at least ``least``; the others are rejected."""
    names = docs.columns
    got = predict(docs.toDF(*[f"_c{i}" for i in range(len(names))]), model, f"_c{names.index(text_col)}", "_lang", "_score")
    return got.filter((F.col("_lang") != UND) & (F.col("_score") >= least)).drop("_lang", "_score").toDF(*names)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return predict(rows, train(docs)).drop("text")
