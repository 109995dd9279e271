"""Text, identity and path functions. Column functions stay in the JVM; where Spark has no built-in (Unicode
normalisation, stemming) an Arrow function runs over distinct values."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An index token: a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
#: A query term: Python's word characters, the same in Java and RE2.
TERM = r"[\p{L}\p{N}_]+"
#: Fixed value: what the token estimate counts: each CJK glyph, each word, each other visible character.
ESTIMATE = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_']+|[^\sA-Za-z0-9_']"
#: The function words that the lexical leg does not search on.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or",
    "that", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with", "you",
)
#: The characters of an identifier or path, and what a version number is, which names nothing.
IDENTIFIER = r"^[A-Za-z_.][A-Za-z0-9_.:/+-]*$"
VERSION = r"^[vV]?[0-9]+(\.[0-9]+)+$"
#: How many terms of a query are read.
MAX_TERMS = 64


@cache
def fold_table() -> tuple[str, str]:
    """(letters with Latin diacritics, their base letters), by canonical decomposition."""
    pairs = [(c, d) for c in map(chr, range(0xC0, 0x250)) if len(d := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and d != c]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics, composed or combining."""
    plain = F.regexp_replace(text, r"[̀-ͯ]", "")
    return F.translate(F.lower(plain), *fold_table())


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), 1)


def query_terms(query: Column) -> Column:
    """The terms to search on: the first MAX_TERMS, lower-cased, without function words unless there are no others."""
    found = F.slice(F.regexp_extract_all(F.lower(query), F.lit(f"({TERM})"), 1), 1, MAX_TERMS)
    kept = F.filter(found, lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ESTIMATE)).cast("long")


def slug(text: Column) -> Column:
    """A heading's slug for text without compatibility characters: runs of letters and digits, joined by hyphens."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(joined == "", "section").otherwise(joined)


def heading_slug(text: str) -> str:
    """The slug of any heading, by compatibility form and case folding."""
    kept = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", text).casefold())
    return "-".join(kept.split()) or "section"


#: Blanks at the end of a line.
LINE_END = re.compile(r"[^\S\n]+(?=\n|\Z)")


def normalize_text(text: str) -> str:
    """Canonical composition, LF line ends, no blanks at line ends, no blank lines at the end; a byte order mark goes."""
    composed = unicodedata.normalize("NFC", text[1:] if text[:1] == "\ufeff" else text)
    return LINE_END.sub("", re.sub("\r\n?", "\n", composed)).rstrip("\n")


@F.arrow_udf(StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Canonical composition, for which Spark has no function."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


#: Python's white space but the line feed, as a class of Java's regular expressions.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"


def normalized(text: Column) -> Column:
    """normalize_text as a column; only texts beyond ASCII go through Python."""
    plain = F.regexp_replace(text, "^\ufeff", "")
    plain = F.when(plain.rlike(r"[^\x00-\x7f]"), composed(F.when(plain.rlike(r"[^\x00-\x7f]"), plain))).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "\r\n?", "\n"), rf"{BLANK}+(?=\n|\z)", ""), r"\n+\z", "")


@F.arrow_udf(StringType())
def slugged(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else heading_slug(t) for t in texts.to_pylist()], pa.string())


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, text as it is; whole floats are integers. What JSON can't hold is refused: numbers that
    aren't finite, keys that aren't strings, objects of other types."""
    match value:
        case None | bool() | int() | str():
            return json.dumps(value, ensure_ascii=False)
        case float() if math.isfinite(value):
            return json.dumps(int(value) if value == int(value) else value)
        case list() | tuple():
            return f"[{','.join(map(canonical_json, value))}]"
        case dict() if all(isinstance(k, str) for k in value):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    raise ValueError(f"JSON can't hold {value!r}")


def json_text(text: Column) -> Column:
    """A string as canonical JSON writes it."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def json_list(*items: Column) -> Column:
    """The canonical JSON of a list of strings; null items are null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(json_text(i), F.lit("null")) for i in items]), F.lit("]"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def build_key(stage: str, version: int, inputs: dict[str, str], config: dict, schema: str) -> str:
    """What the result of a build stage depends on, as one digest."""
    return digest_of({"stage": stage, "impl": version, "inputs": inputs, "config": config, "schema": schema})


def edge_id(source: Column, target: Column, kind: Column, provenance_kind: Column, anchor: Column) -> Column:
    """The digest of an edge's canonical JSON: its ends, its type and the digest of its provenance."""
    provenance = F.concat(F.lit('{"anchor":'), F.coalesce(json_text(anchor), F.lit("null")), F.lit(',"kind":'), json_text(provenance_kind), F.lit("}"))
    return digest(json_list(source, target, kind, digest(provenance)))


def digest_of(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


#: Fixed value: Crockford's base32 digits.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode_ulid(milliseconds: int, randomness: bytes) -> str:
    """26 base32 digits of 48 bits of time and 80 of randomness."""
    if not 0 <= milliseconds < 1 << 48 or len(randomness) != 10:
        raise ValueError("a ULID has 48 bits of milliseconds and 10 random bytes")
    n, out = milliseconds << 80 | int.from_bytes(randomness, "big"), []
    for _ in range(26):
        n, digit = divmod(n, 32)
        out.append(CROCKFORD[digit])
    return "".join(reversed(out))


def decode_ulid(ulid: str) -> tuple[int, bytes]:
    """(milliseconds, random bytes)."""
    if not re.fullmatch(f"[0-7][{CROCKFORD}]{{25}}", ulid):
        raise ValueError(f"not a ULID: {ulid!r}")
    n = 0
    for c in ulid:
        n = n * 32 + CROCKFORD.index(c)
    return n >> 80, (n & (1 << 80) - 1).to_bytes(10, "big")


def minted_ulids(n: int, milliseconds: int, randomness: bytes) -> list[str]:
    """n ULIDs of one millisecond, in rising order."""
    first = int.from_bytes(randomness, "big")
    return [encode_ulid(milliseconds, (first + k).to_bytes(10, "big")) for k in range(n)]


def ulid_time(ulid: Column) -> Column:
    """When a ULID was minted: its first ten digits are milliseconds."""
    ms = F.lit(0).cast("long")
    for k in range(10):
        ms = ms * 32 + (F.instr(F.lit(CROCKFORD), F.substring(ulid, k + 1, 1)) - 1)
    return F.timestamp_millis(ms)


def derived_ulid(key: Column) -> Column:
    """A ULID with timestamp 0 and the first 80 bits of the key's SHA-256: 26 digits of which ten are zeros."""
    h = F.sha2(key, 256)
    parts = []
    for k in range(4):  # 20 bits, five hex digits, are four base32 digits
        group = F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(CROCKFORD), F.shiftright(group, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(F.lit("0" * 10), *parts)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: * within a segment, ** across segments, ? one character."""
    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the path, one of the folders above it, or its last name."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = F.lit(False)
    for g in globs:
        pattern = glob_regex(g)
        hit |= F.exists(above, lambda p: p.rlike(pattern)) | F.element_at(parts, -1).rlike(pattern)  # noqa: B023 - called at once
    return hit


def folded_path(path: Column) -> Column:
    """A relative path with its . and .. steps taken."""
    step = lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(x.isin(".", ""), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def percentile(values: Column, fraction: float, floor: bool = False) -> Column:
    """The element at round(fraction * (n - 1)), by half-even rounding, of the sorted values; floor: rounded down."""
    at = F.lit(fraction) * (F.size(values) - 1)
    place = (F.floor(at) if floor else F.bround(at)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(place, F.lit(1))))


# Porter's stemmer of 1980 with the two departures its author made later. The suffixes of its steps.
DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for a consonant and v for a vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(a):
            word = word[: -len(a)] + b
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for a in ("ed", "ing"):
            if word.endswith(a) and "v" in _shape(word[: -len(a)]):
                word = word[: -len(a)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (DOUBLE_SUFFIXES, SUFFIXES):
        for a, b in table:
            if word.endswith(a):
                word = word[: -len(a)] + b if _measure(word[: -len(a)]) > 0 else word
                break
    for a in ENDINGS:
        if word.endswith(a):
            stem = word[: -len(a)]
            if _measure(stem) > 1 and (a != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(StringType())
def stem_of(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else porter(w) for w in words.to_pylist()], pa.string())


_memoised = lru_cache(1 << 17)(porter)


@F.arrow_udf(StringType())
def stem_stream(texts: pa.Array) -> pa.Array:
    """The stems of a text's terms, joined by a space; a worker stems each of its frequent words once."""
    from loomdex.functions.text import _memoised as stem  # the memo is the worker's own

    return pa.array([None if t is None else " ".join(map(stem, re.findall(r"\w+", t.lower()))) for t in texts.to_pylist()], pa.string())


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """term, stem: each distinct term is stemmed once, whatever its occurrences."""
    return terms.select(column).distinct().withColumn("stem", stem_of(F.col(column)))


# Paths and times


def file_slug(name: Column, otherwise: str) -> Column:
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(joined == "", otherwise).otherwise(joined)


def evidence_path(source_uri: Column, source_digest: Column | None = None, folder: str = "knowledge") -> Column:
    """Where the document of an ingested source lies: named after its file, with eight digits of its digest if given."""
    name = file_slug(F.element_at(F.split(F.regexp_replace(source_uri, "/+$", ""), "/"), -1), "source")
    mark = F.lit("") if source_digest is None else F.concat(F.lit("-"), F.substring(F.regexp_replace(source_digest, "^sha256:", ""), 1, 8))
    return F.concat(F.lit(f"{folder}/evidence/"), name, mark, F.lit(".md"))


def candidate_path(title: Column, folder: str = "knowledge") -> Column:
    """Where a synthesised document lies: named after what it is about."""
    return F.concat(F.lit(f"{folder}/candidate/"), file_slug(title, "candidate"), F.lit(".md"))


def section_of(anchor: Column) -> Column:
    """A chunk's section: its anchor up to and with the last slash."""
    return F.regexp_extract(anchor, "^(.*/)[^/]*$", 1)


def document_of(anchor: Column) -> Column:
    return F.split_part(anchor, F.lit("#"), F.lit(1))


def rfc3339(ts: Column) -> Column:
    """An instant in UTC, in a session whose time zone is UTC; fractions only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))), F.lit("Z"))


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text; null without an offset, as local times mean nothing here."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


#: Source trust from the weakest on.
TRUST = ("unknown", "low", "medium", "high")


def weakest_trust(trusts: Column) -> Column:
    """The weakest of an array of source trusts; null if it names none."""
    places = F.filter(F.transform(trusts, lambda t: F.array_position(F.array(*map(F.lit, TRUST)), t)), lambda k: k > 0)
    return F.when(F.size(places) > 0, F.element_at(F.array(*map(F.lit, TRUST)), F.array_min(places).cast("int")))


def bounded(query: Column) -> Column:
    """A query as far as the end of its last term that is read: what a leg that takes text as it is may see."""
    count = F.regexp_count(query, F.lit(TERM))
    return F.when(count > MAX_TERMS, F.regexp_extract(query, rf"^((?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+){{{MAX_TERMS}}})", 1)).otherwise(query)


def unread_terms(query: Column) -> Column:
    return F.greatest(F.regexp_count(query, F.lit(TERM)) - MAX_TERMS, F.lit(0))
