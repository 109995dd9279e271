"""Markdown to nodes and chunks: a block parser of its own, frontmatter, links and tags.

Each document is parsed on its own in an Arrow function, so a corpus of any size is one map; one malformed document
becomes a row with its error, not a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import ESTIMATE, heading_slug, normalize_text

#: The ceiling of a chunk and how deep blocks may nest.
MAX_TOKENS = 800
MAX_NESTING = 100

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})\s*([^`]*)$")
ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)(.*)$")
TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
BREAK = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
CODE_SPAN = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
INLINE = re.compile(r"(?P<embed>!\[\[(?P<e>[^\]\n]+)\]\])|(?P<wiki>\[\[(?P<w>[^\]\n]+)\]\])|(?P<image>!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)[^)]*\))|(?P<link>\[(?P<label>[^\]]*)\]\((?P<href>[^)\s]+)[^)]*\))|(?<![\w/])(?P<tag>#(?![0-9]+(?:\s|$))\w[\w/-]*)")


@dataclass
class Block:
    kind: str
    text: str
    first: int
    last: int
    level: int = 0
    lang: str = ""
    variant: str = ""
    children: list[Block] = field(default_factory=list)


def split_frontmatter(text: str) -> tuple[dict, str, int, str | None]:
    """(properties, body, lines before the body, what was wrong). Aliases are refused; a byte order mark is skipped."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if not text.startswith("---\n"):
        return {}, text, 0, None
    end = re.search(r"^(---|\.\.\.)[ \t]*$", text[4:], re.M)
    if not end:
        return {}, text, 0, "frontmatter without an end"
    block, body = text[4 : 4 + end.start()], text[4 + end.end() :].removeprefix("\n")
    skipped = text[: len(text) - len(body)].count("\n")
    try:
        if any(isinstance(t, yaml.tokens.AliasToken) for t in yaml.scan(block)):
            return {}, body, skipped, "frontmatter with an alias"
        got = yaml.safe_load(block)
    except yaml.YAMLError as e:
        return {}, body, skipped, f"frontmatter is not YAML: {e.__class__.__name__}"
    if got is None:
        return {}, body, skipped, None
    return (got, body, skipped, None) if isinstance(got, dict) else ({}, body, skipped, "frontmatter is not a mapping")


def upsert_frontmatter(text: str, key: str, value: str) -> str:
    """text with one key of its frontmatter set, all else as it was: mark, line ends and other lines."""
    mark = "﻿" if text.startswith("﻿") else ""
    rest = text.removeprefix("﻿")
    end = "\r\n" if "\r\n" in rest.split("\n", 1)[0] + "\n" and rest.find("\r\n") >= 0 else "\n"
    line = f"{key}: {value}"
    if not rest.startswith("---" + end):
        return f"{mark}---{end}{line}{end}---{end}{rest}"
    properties, _, _, wrong = split_frontmatter(rest)
    if wrong:
        raise ValueError(wrong)
    close = re.search(r"^---[ \t]*\r?$", rest[3 + len(end) :], re.M)
    head, tail = rest[: 3 + len(end) + close.start()], rest[3 + len(end) + close.start() :]
    pattern = re.compile(rf"^{re.escape(key)}[ \t]*:.*?(?=\r?$)", re.M)
    head = pattern.sub(lambda _: line, head, count=1) if key in properties else f"{head}{line}{end}"
    return mark + head + tail


def callout(line: str) -> tuple[str, str] | None:
    """(type, title) if the line heads a callout: a type after an exclamation mark in brackets, then perhaps a title."""
    head, closed, title = line.strip().partition("]")
    kind = head.removeprefix("[!")
    sound = closed and kind != head and kind.isascii() and kind.replace("-", "").replace("_", "a").isalnum()
    return (kind.lower(), title.strip()) if sound else None


def parse(text: str, first: int = 1, depth: int = 0) -> list[Block]:
    """The blocks of a text; lines are numbered from ``first``."""
    if depth > MAX_NESTING:
        raise ValueError("blocks nest too deep")
    lines, out, k = text.split("\n"), [], 0
    while k < len(lines):
        line = lines[k]
        if not line.strip() or BREAK.match(line):
            k += 1
            continue
        if m := FENCE.match(line):
            j = k + 1
            closing = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while j < len(lines) and not closing.match(lines[j]):
                j += 1
            out.append(Block("code_block", "\n".join(lines[k + 1 : j]), first + k, first + min(j, len(lines) - 1), lang=m[3].strip().split(" ")[0].lower()))
            k = j + 1
        elif m := HEADING.match(line):
            out.append(Block("heading", (m[2] or "").strip(), first + k, first + k, level=len(m[1])))
            k += 1
        elif re.match(r"^ {0,3}>", line):
            j = k
            while j < len(lines) and (re.match(r"^ {0,3}>", lines[j]) or (lines[j].strip() and j > k and not _opens(lines[j]))):
                j += 1
            inner = [re.sub(r"^ {0,3}> ?", "", x) for x in lines[k:j]]
            if c := callout(inner[0]):
                out.append(Block("callout", c[1], first + k, first + j - 1, variant=c[0], children=parse("\n".join(inner[1:]), first + k + 1, depth + 1)))
            else:
                out.append(Block("quote", "\n".join(inner), first + k, first + j - 1, children=parse("\n".join(inner), first + k, depth + 1)))
            k = j
        elif ITEM.match(line):
            out.append(_list(lines, k, first, depth))
            k = out[-1].last - first + 1
        elif "|" in line and k + 1 < len(lines) and TABLE_RULE.match(lines[k + 1]) and "-" in lines[k + 1]:
            j = k + 2
            while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                j += 1
            rows = [[c.strip() for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))] for n, x in enumerate(lines[k:j]) if n != 1]
            kids = [Block("table_row", " | ".join(r), first + k + (n + 1 if n else 0), first + k + (n + 1 if n else 0), children=[Block("table_cell", c, first + k, first + k) for c in r]) for n, r in enumerate(rows)]
            out.append(Block("table", "\n".join(lines[k:j]), first + k, first + j - 1, children=kids))
            k = j
        else:
            j = k + 1
            while j < len(lines) and lines[j].strip() and not _opens(lines[j]):
                if re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j]):
                    break
                j += 1
            if j < len(lines) and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j])):
                out.append(Block("heading", " ".join(x.strip() for x in lines[k:j]), first + k, first + j, level=1 if m[1][0] == "=" else 2))
                j += 1
            else:
                out.append(Block("paragraph", "\n".join(x.strip() for x in lines[k:j]), first + k, first + j - 1))
            k = j
    return out


def _opens(line: str) -> bool:
    """Whether a line ends the paragraph above it."""
    return bool(HEADING.match(line) or FENCE.match(line) or BREAK.match(line) or re.match(r"^ {0,3}>", line) or re.match(r"^ {0,3}([-*+]|1[.)])[ \t]+\S", line))


def _list(lines: list[str], k: int, first: int, depth: int) -> Block:
    """The list that starts at line k; deeper lines belong to its items."""
    start = ITEM.match(lines[k])
    ordered, items, j = start[2][-1] in ".)", [], k
    while j < len(lines):
        m = ITEM.match(lines[j])
        if not m or (m[2][-1] in ".)") != ordered or BREAK.match(lines[j]):
            break
        indent = len(m[1]) + len(m[2]) + max(1, min(len(m[3]), 4))
        body, e = [m[4]], j + 1
        while e < len(lines):
            line = lines[e]
            if not line.strip():
                if e + 1 < len(lines) and len(lines[e + 1]) - len(lines[e + 1].lstrip()) >= indent:
                    body.append("")
                    e += 1
                    continue
                break
            deep = len(line) - len(line.lstrip()) >= indent
            if not deep and (_opens(line) or ITEM.match(line)):
                break
            body.append(line[indent:] if deep else line.strip())
            e += 1
        items.append(Block("list_item", "\n".join(body), first + j, first + e - 1, children=parse("\n".join(body), first + j, depth + 1)))
        j = e
        while j < len(lines) and not lines[j].strip() and j + 1 < len(lines) and ITEM.match(lines[j + 1]):
            j += 1
    return Block("list", "\n".join(lines[k:j]).rstrip(), first + k, items[-1].last, variant="ordered" if ordered else "bullet", children=items)


def references(text: str) -> list[tuple[str, str]]:
    """(kind, target) of the links, images, embeds and tags outside code spans, in order."""
    plain = CODE_SPAN.sub(lambda m: " " * len(m[0]), text)
    out = []
    for m in INLINE.finditer(plain):
        kind = m.lastgroup and next(g for g in ("embed", "wiki", "image", "link", "tag") if m[g])
        name = {"wiki": "wikilink", "tag": "tag_ref"}.get(kind, kind)
        target = {"embed": m["e"], "wiki": m["w"], "image": m["src"], "link": m["href"], "tag": m["tag"]}[kind]
        out.append((name, target.split("|")[0].strip() if kind in ("embed", "wiki") else target.lstrip("#") if kind == "tag" else target))
    return out


def tokens_of(text: str) -> int:
    return len(re.findall(ESTIMATE, text))


def chunk(path: str, blocks: list[Block], target: int = MAX_TOKENS, most: int = MAX_TOKENS) -> list[dict]:
    """The chunks of a document: units of a section are packed until they reach ``target`` or the next would pass
    ``most``; a callout is a group of its own. A heading opens the first chunk of its section. A document's only
    first-level heading is in the heading path, but not in the anchors."""
    tops = [b for b in blocks if b.kind == "heading" and b.level == 1]
    title = tops[0] if len(tops) == 1 else None
    out, stack, slugs_seen, ordinal = [], [], {}, {}
    held: list[Block] = []
    weight = 0  # of what is held
    group = ""

    def flush() -> None:
        nonlocal held, weight
        if not held:
            return
        slugs = "/".join(s for _, _, s, b in stack if b is not title)
        n = ordinal.get(slugs, 0)
        ordinal[slugs] = n + 1
        text = normalize_text("\n\n".join(_source(b) for b in held))
        body = [b for b in held if b.kind != "heading"]
        kind = {"table": "table", "code_block": "code", "callout": "callout"}.get(body[0].kind, "text") if len(body) == 1 else "text"
        out.append({"anchor": f"{path}#{slugs}/{n}", "heading_path": [t for _, t, _, _ in stack], "text": text, "tokens": tokens_of(text), "first": held[0].first, "last": held[-1].last, "kind": kind})
        held, weight = [], 0

    for b in blocks:
        if b.kind == "heading":
            flush()
            while stack and stack[-1][0] >= b.level:
                stack.pop()
            slug = heading_slug(b.text)
            parent = "/".join(s for _, _, s, _ in stack)
            n = slugs_seen[parent, slug] = slugs_seen.get((parent, slug), 0) + 1
            stack.append((b.level, b.text, slug if n == 1 else f"{slug}-{n}", b))
            held, weight, group = [b], tokens_of(_source(b)), ""
            continue
        own = f"callout:{b.first}" if b.kind == "callout" else ""
        body = any(x.kind != "heading" for x in held)
        if body and (own != group or weight >= target or weight + tokens_of(_source(b)) > most):
            flush()
        group = own
        for part in _split(b, most):
            size = tokens_of(_source(part))
            if any(x.kind != "heading" for x in held) and weight + size > most:
                flush()
            held.append(part)
            weight += size
    flush()
    return out


def _source(b: Block) -> str:
    if b.kind == "heading":
        return f"{'#' * b.level} {b.text}"
    if b.kind == "code_block":
        return f"```{b.lang}\n{b.text}\n```"
    if b.kind == "callout":
        return "\n\n".join([f"[!{b.variant}] {b.text}".rstrip(), *(_source(c) for c in b.children)])
    return b.text


def _split(b: Block, most: int) -> list[Block]:
    """A block over the ceiling in parts: a paragraph at sentence ends, others at line ends; a table's parts repeat its head
    and a fence's parts are fences of its language. A line over the ceiling stays whole."""
    if b.kind in ("heading", "callout") or tokens_of(_source(b)) <= most:
        return [b]
    pieces = re.split(r"(?<=[.!?])\s+", b.text) if b.kind == "paragraph" else b.text.split("\n")
    joint = " " if b.kind == "paragraph" else "\n"
    head = pieces[:2] if b.kind == "table" else []
    out, held, weight = [], list(head), sum(map(tokens_of, head))
    for piece in pieces[len(head) :]:
        size = tokens_of(piece)
        if len(held) > len(head) and weight + size > most:
            out.append(replace(b, text=joint.join(held)))
            held, weight = list(head), sum(map(tokens_of, head))
        held.append(piece)
        weight += size
    return [*out, replace(b, text=joint.join(held))] if len(held) > len(head) or not out else out


def flat(blocks: list[Block], parent: int = -1) -> Iterator[tuple[int, Block]]:
    """(place of the parent or -1, block), parents before children."""
    n = 0
    todo = [(parent, b) for b in reversed(blocks)]
    while todo:
        p, b = todo.pop()
        yield p, b
        todo += [(n, c) for c in reversed(b.children)]
        n += 1


NODES = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("lang", pa.string()), ("variant", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("refs", pa.list_(pa.struct([("kind", pa.string()), ("target", pa.string())]))), ("error", pa.string())])
CHUNKS = pa.schema([("path", pa.string()), ("anchor", pa.string()), ("heading_path", pa.list_(pa.string())), ("text", pa.string()), ("tokens", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string())])


def nodes(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """A row for each node of each document; a document that can't be parsed is one opaque node with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, body, skipped, wrong = split_frontmatter(text or "")
                try:
                    found = list(flat(parse(body, skipped + 1)))
                except (ValueError, RecursionError) as e:
                    rows.append({"path": path, "ord": 0, "parent": -1, "kind": "opaque", "text": "", "level": 0, "lang": "", "variant": "lost", "first": 1, "last": 1, "refs": [], "error": str(e)})
                    continue
                for n, (p, x) in enumerate(found):
                    inline = x.kind in ("heading", "paragraph", "table_cell")
                    rows.append({"path": path, "ord": n, "parent": p, "kind": x.kind, "text": x.text, "level": x.level, "lang": x.lang, "variant": x.variant, "first": x.first, "last": x.last, "refs": [{"kind": k, "target": t} for k, t in references(x.text)] if inline else [], "error": wrong if n == 0 else None})
            yield pa.RecordBatch.from_pylist(rows, NODES)

    return docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "path string, ord int, parent int, kind string, text string, level int, lang string, variant string, first int, last int, refs array<struct<kind:string,target:string>>, error string")


def chunks(docs: DataFrame, path_col: str = "path", text_col: str = "text", target: int = MAX_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """anchor, heading_path, text, tokens, first, last, kind, chunk_digest of each chunk of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, body, skipped, _ = split_frontmatter(text or "")
                try:
                    rows += [{"path": path, **c} for c in chunk(path, parse(body, skipped + 1), target, most)]
                except (ValueError, RecursionError):
                    continue  # nodes() reports it
            yield pa.RecordBatch.from_pylist(rows, CHUNKS)

    cut = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "path string, anchor string, heading_path array<string>, text string, tokens long, first int, last int, kind string")
    return cut.withColumn("chunk_digest", F.concat(F.lit("sha256:"), F.sha2("text", 256)))


def links(node_table: DataFrame) -> DataFrame:
    """path, ord, kind, target: the references of each document in order."""
    each = node_table.select("path", F.col("ord").alias("node"), F.posexplode("refs").alias("k", "r"))
    return each.select("path", (F.col("node").cast("long") * (1 << 32) + F.col("k")).alias("ord"), "r.kind", "r.target")
