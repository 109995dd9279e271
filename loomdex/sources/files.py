"""Files in and out: corpus scan, JSONL bundles, judged cases, and content-addressed tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.sources import html

CASES = "case_id string, query string, slices array<string>, relevant array<struct<anchor:string,grade:int>>, answerable boolean, note string"
TASKS = "task_id string, kind string, prompt string, requires array<string>, note string"


#: Folders that a build makes, which hold no sources.
DERIVED = ("build", "dist", "node_modules", "site", "target", "venv", "__pycache__")


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = (), largest: int | None = None, pattern: str = "*.md", derived: Iterable[str] = DERIVED) -> DataFrame:
    """path (relative), source_digest, length, modified, text of the files under root, without hidden and derived folders and
    what a glob excludes. Filters on path and length come before the content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    rel = F.regexp_replace("path", f"^[a-z]*:/*{base.lstrip('/')}/", "")
    kept = files.withColumn("rel", rel).filter(~F.col("rel").rlike(r"(^|/)\."))
    made = "|".join(map(re.escape, derived))
    if made:
        kept = kept.filter(~F.col("rel").rlike(f"(^|/)({made})/"))
    globs = list(exclude)
    if globs:
        kept = kept.filter(~X.excluded(F.col("rel"), globs))
    if largest is not None:
        kept = kept.filter(F.col("length") <= largest)
    return kept.select(F.col("rel").alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_digest"), "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def acquire(spark: SparkSession, source: str, roots: Iterable[str], largest: int | None = None) -> DataFrame:
    """source_uri, source_digest, length, media, warning, content of the files at source, which has to lie in a declared root.
    A file over the ceiling is refused before it is read: its content and digest are null and the warning says so."""
    clean = lambda p: os.path.normpath(p.removeprefix("file://").removeprefix("file:"))
    if not any(os.path.commonpath([clean(source), clean(r)]) == clean(r) for r in roots if clean(source).startswith(clean(r))):
        raise PermissionError(f"{source} lies in no declared root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    fits = F.lit(True) if largest is None else F.col("length") <= largest
    small, big = files.filter(fits), files.filter(~fits).select("path", "length")
    read = small.select(F.col("path").alias("source_uri"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_digest"), "length", html.media_type(F.col("path")).alias("media"), html.mismatch(F.col("path"), F.col("content")).alias("warning"), "content")
    refused = big.select(F.col("path").alias("source_uri"), F.lit(None).cast("string").alias("source_digest"), "length", html.media_type(F.col("path")).alias("media"), F.lit("too large").alias("warning"), F.lit(None).cast("binary").alias("content"))
    return read.unionByName(refused)


def write_cases(cases: DataFrame, path: str, key: str = "case_id") -> None:
    """Judged cases or tasks as JSON lines with sorted keys; a key that occurs twice is refused before anything is written."""
    twice = cases.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {', '.join(str(r[0]) for r in twice)}")
    export_jsonl(cases, [key], path)


def export_bundle(tables: dict[str, DataFrame], orders: dict[str, list[str]], path: str, current: DataFrame | None = None) -> None:
    """A JSON lines folder for each table that orders names, whole or not at all: documents whose chunks disagree with their
    count, or chunks without a document, are a torn state and refused. current: path, source_digest of the sources as they
    are now; a document that was compiled from other bytes, or whose source is gone, is refused too."""
    docs, chunks = tables["documents"], tables["chunks"]
    if not chunks.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty():
        raise ValueError("there are chunks without a document")
    if "chunks" in docs.columns:
        counted = docs.select("doc_id", "chunks").join(chunks.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id", "left")
        if not counted.filter(F.col("chunks") != F.coalesce("_n", F.lit(0))).isEmpty():
            raise ValueError("documents and their chunks disagree")
    if current is not None:
        now = docs.select("path", "content_digest").join(current.select("path", "source_digest"), "path", "left")
        if not now.filter(~F.col("content_digest").eqNullSafe(F.col("source_digest"))).isEmpty():
            raise ValueError("sources have changed since they were compiled")
    for name, order in orders.items():
        export_jsonl(tables[name], order, f"{path}/{name}")


def export_jsonl(rows: DataFrame, order: list[str], path: str) -> None:
    """Canonical JSON lines: columns by name, nulls kept, rows in the given order over ordered parts."""
    named = rows.select(*sorted(rows.columns))
    named.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read_cases(spark: SparkSession, path: str, schema: str = CASES, key: str = "case_id") -> DataFrame:
    """Judged cases or tasks; a key that occurs twice is refused."""
    rows = spark.read.schema(schema).json(path)
    twice = rows.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {', '.join(str(r[0]) for r in twice)}")
    return rows
