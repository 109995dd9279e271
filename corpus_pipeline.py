"""The training-data pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents, and pass columns that they don't know through, whatever their names. run() writes
each stage's result to the work folder and reads it as the next one's docs, so a lost executor repeats tasks of one stage
only. Texts are read whole, however long; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import bpe, langid, linededup, mixing, similar
from loomdex.llm.common import materialize

#: The words from which a repeated single line, or pair of lines, is a repeat of its own.
LINE_WORDS = 6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and rejects texts without a letter, or of no language with a posterior of a half:
    null and empty texts go. Equal posteriors go to the first language by name; rows that repeat are judged alike. A null
    lang or doc_id is not learnt from."""
    return langid.keep_identified(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stand earlier, of three lines or more or of LINE_WORDS words or more; a document that loses
    all its lines goes. A null text stays as it is; a null doc_id is later than all others; rows that share a doc_id are one
    document, so none of them is earlier than another at the same line, and equal rows all stay."""
    return linededup.dedup_lines(docs, keep_emptied=False, words=LINE_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of documents that share 4/5 of their five-word shingles,
    by SimHash first and then by an exact search for what it leaves apart; where rows share that id, the one with the smallest hash of its text, once. A null doc_id is the largest; texts without
    a word, and null ones, are copies of each other."""
    return similar.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go. A null source is one of its own, a null
    text has no words and is taken like the others of its source; ties in the seeded order are broken by id, then by size."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each row, repeated rows and null ids too; a null text is empty."""
    return bpe.encode_decode(docs, keep_ids=True, memo=50_000)  # beside what earlier stages left on an executor


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("source mixing", mixture), ("BPE", tokens)]

#: Language ID, SimHash and BPE are not SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
