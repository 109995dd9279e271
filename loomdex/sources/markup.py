"""Raw HTML in Markdown text, taken out without its words; and the parsers that a media type can have."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomdex.sources.markdown import CODE_SPAN


def tags_in(text: str) -> list[tuple[int, int, str, bool, bool]]:
    """(start, end, name, whether it closes, whether it has an attribute) of each tag, read from left to right."""
    out, at = [], text.find("<")
    while at >= 0:
        end = text.find(">", at)
        if end < 0:
            break
        inner = text[at + 1 : end]
        closes, body = inner.startswith("/"), inner.removeprefix("/")
        name = body.split(None, 1)[0] if body[:1].isalpha() and body.split() else ""
        sound = name.isascii() and name.replace("-", "").isalnum() and "<" not in inner
        rest = body[len(name) :]
        if sound and (not rest.strip() if closes else not rest or rest[0].isspace()):
            out.append((at, end + 1, name.lower(), closes, not closes and has_attribute(rest)))
            at = text.find("<", end + 1)
        else:
            at = text.find("<", at + 1)
    return out


def has_attribute(rest: str) -> bool:
    """Whether what stands after a tag's name gives a name a value."""
    for piece, value in zip(rest.split("=")[:-1], rest.split("=")[1:], strict=True):
        name = piece.rstrip().rsplit(None, 1)[-1] if piece.strip() else ""
        if piece[: len(piece.rstrip()) - len(name)][-1:].isspace() and name[:1].isalpha() and name.replace("-", "").isalnum() and value.strip():
            return True
    return False


def strip_markup(text: str) -> str:
    """text without comments, closing tags, and opening tags that have an attribute or a closing tag in the same text; a
    lone word in angle brackets is prose. Nothing inside a code span goes, but for a comment around it."""
    if "<" not in text:
        return text
    code = [m.span() for m in CODE_SPAN.finditer(text)]
    masked = list(text)
    for a, b in code:
        masked[a:b] = "\0" * (b - a)
    tags = tags_in("".join(masked))
    paired = {t[2] for t in tags if t[3]} & {t[2] for t in tags if not t[3]}
    gone = [(a, b) for a, b, name, closes, attribute in tags if closes or attribute or name in paired]
    at = text.find("<!--")
    while at >= 0 and (end := text.find("-->", at + 4)) >= 0:
        gone.append((at, end + 3))
        at = text.find("<!--", end + 3)
    if not gone:
        return text
    out, at = [], 0
    for a, b in sorted(gone):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]]).strip()


@F.arrow_udf(StringType())
def stripped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else strip_markup(t) for t in texts.to_pylist()], pa.string())


class Registry:
    """Parsers by name, in order; the first that takes a media type is the one for it. Built-in names can't be taken over,
    and every parser says whether it gives the same for the same bytes."""

    def __init__(self) -> None:
        self._parsers: dict[str, tuple[frozenset[str], Callable, bool, bool]] = {}

    def add(self, name: str, media: set[str], parse: Callable, deterministic: bool = True, built_in: bool = False) -> None:
        if name in self._parsers:
            raise ValueError(f"there is a parser {name} already")
        self._parsers[name] = (frozenset(media), parse, deterministic, built_in)

    def names(self) -> list[str]:
        """Built-in ones first, then by name."""
        return sorted(self._parsers, key=lambda n: (not self._parsers[n][3], n))

    def for_media(self, media: str) -> tuple[str, Callable]:
        for name in self.names():
            if media in self._parsers[name][0]:
                return name, self._parsers[name][1]
        raise LookupError(f"no parser for {media}; parsers: {', '.join(self.names())}")

    def of(self, media: Column) -> Column:
        """The parser's name for a column of media types, null without one."""
        out = F.lit(None).cast("string")
        for name in reversed(self.names()):
            out = F.when(media.isin(*sorted(self._parsers[name][0])), name).otherwise(out)
        return out
