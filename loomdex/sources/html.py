"""HTML: decoding, text blocks, and guards, row by row in Arrow functions of the standard library's parser."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Media types by extension.
MEDIA = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".rst": "text/x-rst", ".tex": "application/x-latex",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".odt": "application/vnd.oasis.opendocument.text", ".epub": "application/epub+zip",
}
ZIPPED = (MEDIA[".docx"], MEDIA[".odt"], MEDIA[".epub"])
MAX_DEPTH = 256
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "div", "article", "section", "title", "figcaption", "dt", "dd"}
SKIPPED = {"script", "style", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def media_type(path: Column) -> Column:
    ext, out = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit(None).cast("string")
    for e, m in MEDIA.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def sniffed(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("504B0304") | head.startswith("504B0506"), "application/zip")


def mismatch(path: Column, content: Column) -> Column:
    """A warning where the bytes contradict the name; silence of the bytes contradicts nothing."""
    named, seen = media_type(path), sniffed(content)
    agrees = (named == seen) | ((seen == "application/zip") & named.isin(*ZIPPED))
    return F.when(named.isNotNull() & seen.isNotNull() & ~agrees, F.concat(F.lit("named "), named, F.lit(" but is "), seen))


def decode(data: bytes) -> tuple[str, str, str]:
    """(text, encoding, the rule that decided): byte order mark, declared charset, UTF-8, windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, "bom"
    m = re.search(rb"<meta[^>]+charset=[\"']?([A-Za-z0-9_.:-]+)", data[:4096], re.I)
    if m:
        try:
            name = codecs.lookup(m[1].decode()).name
            return data.decode(name), name, "declared"
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        return data.decode("utf-8"), "utf-8", "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), "windows-1252", "fallback"


DECODED = StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("rule", StringType())])


@F.arrow_udf(DECODED)
def decoded(content: pa.Array) -> pa.Array:
    """decode() of a column of bytes."""
    rows = [None if b is None else dict(zip(("text", "encoding", "rule"), decode(b), strict=True)) for b in content.to_pylist()]
    return pa.array(rows, pa.struct([("text", pa.string()), ("encoding", pa.string()), ("rule", pa.string())]))


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.kind, self.deepest = "p", 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.out.append((self.kind, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag == "br":
            self.flush()
            self.kind = tag if tag != "br" else self.kind
        if tag not in VOID:
            self.stack.append(tag)
            self.deepest = max(self.deepest, len(self.stack))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            if BLOCKS.intersection(self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]):
                self.flush()
            while self.stack.pop() != tag:
                pass
        self.kind = next((t for t in reversed(self.stack) if t in BLOCKS), "p")

    def handle_data(self, data: str) -> None:
        if not SKIPPED.intersection(self.stack):
            self.text.append(data)


def blocks_of(html: str) -> tuple[list[tuple[str, str]], int]:
    """((kind, text) of each block in order, the deepest nesting)."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.out, p.deepest


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, ord, kind, text of each block; a page nested too deep is one refused row."""
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, deepest = blocks_of(html or "")
                if deepest > MAX_DEPTH:
                    found = [("refused", f"nests {deepest} deep")]
                rows += [{"page_id": i, "ord": k, "kind": kind, "text": text} for k, (kind, text) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, ord int, kind string, text string")


def to_markdown(block_table: DataFrame) -> DataFrame:
    """page_id, text: each page's blocks as Markdown; text that would open a block is escaped."""
    escaped = F.regexp_replace("text", r"^(#{1,6}\s|[-*+]\s|>|\d+[.)]\s|```|~~~|\|)", r"\\$1")
    level = F.regexp_extract("kind", r"^h([1-6])$", 1)
    line = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), "text")).when(F.col("kind") == "li", F.concat(F.lit("- "), escaped)).otherwise(escaped)
    listed = block_table.withColumn("line", line).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return listed.select("page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))
