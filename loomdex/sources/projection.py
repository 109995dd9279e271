"""The Markdown that stands for an ingested source: its provenance as frontmatter, its blocks as text that reads back as
those blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import normalize_text
from loomdex.sources.markdown import parse, split_frontmatter

#: Fixed value: the keys of the provenance, in order.
PROVENANCE = ("title", "origin", "source", "source_digest", "source_trust", "generated_by")
#: Fixed value: what begins a block of another kind at the start of a line.
OPENERS = ("#", ">", "-", "*", "+", "|", "```", "~~~", "=")


def escaped(text: str) -> str:
    """A paragraph's text with every line that would open another block escaped."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        number = bare[: len(bare) - len(bare.lstrip("0123456789"))]
        if bare.startswith(OPENERS):
            bare = "\\" + bare
        elif number and bare[len(number) : len(number) + 1] in (".", ")"):
            bare = f"{number}\\{bare[len(number) :]}"
        out.append(bare)
    return "\n".join(out)


def render(kind: str, text: str) -> str:
    if kind[:1] == "h" and kind[1:].isdigit():
        return f"{'#' * int(kind[1:])} {' '.join(text.split())}"
    if kind == "li":
        return "- " + escaped(text).replace("\n", "\n  ")
    if kind == "pre":
        fence = "`" * max(3, 1 + max((len(run) for run in text.replace("\n", " ").split() if set(run) == {"`"}), default=0))
        return f"{fence}\n{text}\n{fence}"
    if kind == "blockquote":
        return "\n".join(f"> {line}" for line in escaped(text).split("\n"))
    return escaped(text)


def project(provenance: dict[str, str | None], blocks: list[tuple[str, str]]) -> str:
    """The whole document."""
    held = {k: provenance[k] for k in PROVENANCE if provenance.get(k)}
    head = yaml.safe_dump(held, sort_keys=False, allow_unicode=True, width=1 << 20)
    body: list[str] = []
    for n, (kind, text) in enumerate(blocks):
        if kind == "li" and n and blocks[n - 1][0] == "li":
            body[-1] += "\n" + render(kind, text)  # one list
        else:
            body.append(render(kind, text))
    return f"---\n{head}---\n\n" + "\n\n".join(body) + "\n"


def reads_back(text: str, provenance: dict[str, str | None], blocks: list[tuple[str, str]]) -> str | None:
    """What differs when a projection is read again, or None."""
    held, body, first, wrong = split_frontmatter(text)
    if wrong:
        return wrong
    for key in PROVENANCE:
        if (provenance.get(key) or None) != (str(held[key]) if key in held else None):
            return f"{key} differs"
    plain = lambda s: "".join(c for c in s if c.isalnum())  # noqa: E731 - words, without marks and escapes
    got = parse(body, first + 1)
    if sum(b.kind == "heading" for b in got) != sum(k[:1] == "h" and k[1:].isdigit() for k, _ in blocks):
        return "headings differ"
    if plain("".join(b.text for b in got)) != plain("".join(t for _, t in blocks)):
        return "words differ"
    return None


def projections(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, text, problem of each source's document. sources: key, path and the provenance's columns; blocks: key, ord, kind,
    text. A projection that doesn't read back as it was written has a problem."""
    listed = blocks.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("blocks"))
    held = [F.col(k).cast("string").alias(k) if k in sources.columns else F.lit(None).cast("string").alias(k) for k in PROVENANCE]
    rows = sources.select("key", "path", F.struct(*held).alias("provenance")).join(listed, "key", "left").select("path", "provenance", "blocks")
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, provenance, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs = [(x["kind"], x["text"]) for x in found or []]
                text = project(provenance, pairs)
                out.append({"path": path, "text": normalize_text(text) + "\n", "problem": reads_back(text, provenance, pairs)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, "path string, text string, problem string")
