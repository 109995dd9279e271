"""The driver's tables as a corpus: documents, chunks and link graph in the records of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, title, collection, namespace, text: what a document says of itself."""
    path = F.concat(F.lit("knowledge/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("source").alias("title"), F.col("source").alias("collection"), F.col("lang").alias("namespace"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, title, collection, namespace, status, trust, text: a row for each document.

    The label's quality stands for the verification status and its toxicity for the trust class.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = named(spark, sf_dir).join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "candidate").otherwise("evidence")
    trust = F.when(F.col("toxic") == 1, "ingested").otherwise("authored")
    return docs.select("doc_id", "path", "title", "collection", "namespace", status.alias("status"), trust.alias("trust"), "text")


def chunks(docs: DataFrame, *more: str) -> DataFrame:
    """anchor, doc_id, ordinal, text, chunk_digest, tokens: the non-blank lines of each document in order; more: columns of it that they take along."""
    lines = docs.select("doc_id", "path", *more, F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("ordinal", "line"))
    text = F.rtrim("line")
    return lines.select(F.concat("path", F.lit("#/"), F.col("ordinal").cast("string")).alias("anchor"), "doc_id", F.col("ordinal").cast("long").alias("ordinal"), text.alias("text"), X.digest(text).alias("chunk_digest"), X.token_estimate(text).alias("tokens"), *more)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, path, ord, target: each href of a page's anchors, in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*", ""), r"[?#].*$", "")
    return pages.select("page_id", path.alias("path"), F.posexplode(found).alias("ord", "target")).withColumn("ord", F.col("ord").cast("long"))
