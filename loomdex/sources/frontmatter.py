"""Frontmatter as columns: the keys that the engine reads, checked, and all others as they are."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import CROCKFORD, TRUST
from loomdex.sources.markdown import split_frontmatter, upsert_frontmatter

#: The origins of a document, and the most bytes of a block.
ORIGINS = ("authored", "ingested", "synthesized")
MOST_BYTES = 64 << 10
#: The keys that are read, by what they hold.
TEXT, LISTS = ("title", "collection", "source", "generated_by", "verified_by"), ("aliases", "tags", "supersedes")
CHOICES = {"origin": ORIGINS, "source_trust": TRUST}
KEYS = ("id", *TEXT, *LISTS, *CHOICES, "source_digest", "verified_at", "grounding")

SCHEMA = "path string, id string, " + "".join(f"{k} string, " for k in (*TEXT, *CHOICES, "source_digest")) + "".join(f"{k} array<string>, " for k in LISTS) + "verified_at date, grounding double, properties string, warnings array<string>, error string, body string"


class Reader:
    """The values of one document, with what was wrong with them. People's keys are dropped with a warning where they make
    no sense; a claimed identity that makes none is an error, as it must not be made anew."""

    def __init__(self, held: dict) -> None:
        self.held = {str(k): v for k, v in held.items()}
        self.warnings: list[str] = []
        self.error: str | None = None

    def drop(self, key: str, why: str) -> None:
        self.warnings.append(f"{key}: {why}")

    def scalar(self, key: str, value: object) -> str | None:
        if isinstance(value, bool):
            return self.drop(key, "an unquoted boolean isn't text")
        if isinstance(value, str | int | float | datetime.date):
            return str(value)
        return None if value is None else self.drop(key, "isn't text")

    def text(self, key: str) -> str | None:
        return self.scalar(key, self.held.get(key))

    def several(self, key: str) -> list[str]:
        value = self.held.get(key)
        each = value if isinstance(value, list) else [] if value is None else [value]
        return [t for v in each if (t := self.scalar(key, v)) is not None]

    def choice(self, key: str) -> str | None:
        value = self.text(key)
        if value is None or value in CHOICES[key]:
            return value
        return self.drop(key, f"is not one of {', '.join(CHOICES[key])}")

    def identity(self, key: str) -> str | None:
        if key not in self.held:
            return None
        value = str(self.held[key])
        if len(value) == 26 and value[0] in "01234567" and set(value) <= set(CROCKFORD):
            return value
        self.error = f"{key} is not a ULID: {value!r}"
        return None

    def digest(self, key: str) -> str | None:
        value = self.held.get(key)
        if value is None:
            return None
        head, _, digits = str(value).partition(":")
        if head == "sha256" and len(digits) == 64 and set(digits) <= set("0123456789abcdef"):
            return str(value)
        return self.drop(key, "is not a SHA-256 digest")

    def date(self, key: str) -> datetime.date | None:
        value = self.held.get(key)
        try:
            return None if value is None else datetime.date.fromisoformat(str(value)[:10])
        except ValueError:
            return self.drop(key, "is not a date")

    def share(self, key: str) -> float | None:
        try:
            value = None if self.held.get(key) is None else float(self.held[key])
        except (TypeError, ValueError):
            return self.drop(key, "is not a number")
        return value if value is None or 0 <= value <= 1 else self.drop(key, "is not between 0 and 1")

    def others(self, known: set[str]) -> dict[str, object]:
        out = {}
        for key, value in self.held.items():
            if key not in known:
                try:
                    out[key] = json.loads(json.dumps(value, default=lambda v: v.isoformat(), allow_nan=False))
                except (TypeError, ValueError, AttributeError):
                    self.drop(key, "JSON can't hold it")
        return out


def read(text: str, id_key: str = "id") -> dict[str, object]:
    """The frontmatter of one text, under the names of KEYS, with properties, warnings, error and body."""
    held, body, _, wrong = split_frontmatter(text)
    r = Reader(held)
    out: dict[str, object] = {"id": r.identity(id_key), **{k: r.text(k) for k in TEXT}, **{k: r.choice(k) for k in CHOICES}, **{k: r.several(k) for k in LISTS}}
    out |= {"source_digest": r.digest("source_digest"), "verified_at": r.date("verified_at"), "grounding": r.share("grounding")}
    out["properties"] = json.dumps(r.others({id_key, *KEYS}), ensure_ascii=False, sort_keys=True)
    if len(text) - len(body) > MOST_BYTES:
        wrong = f"the block is over {MOST_BYTES} bytes"
    return out | {"warnings": r.warnings, "error": r.error or wrong, "body": body}


def frontmatter(docs: DataFrame, id_key: str = "id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """A row for each document: SCHEMA. A malformed block or identity is an error in its row, never a failed job."""
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]

    def kind(sql: str) -> pa.DataType:
        return {"string": pa.string(), "array<string>": pa.list_(pa.string()), "date": pa.date32(), "double": pa.float64()}[sql]

    schema = pa.schema([(part.split(" ")[0], kind(part.split(" ")[1])) for part in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, **read(t or "", id_key)} for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    return docs.select(F.col(path_col), F.col(text_col)).mapInArrow(run, SCHEMA)


def stamped(docs: DataFrame, key: str, value_col: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, text, refused: each text with one key of its frontmatter set to value_col, and nothing else changed; a block
    that can't be read is refused and its text stays."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("refused", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows.append({"path": path, "text": upsert_frontmatter(text, key, value), "refused": None})
                except ValueError as e:
                    rows.append({"path": path, "text": text, "refused": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(path_col, text_col, F.col(value_col).cast("string")).mapInArrow(run, "path string, text string, refused string")

