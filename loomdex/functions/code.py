"""What a piece of code defines and calls, in languages of braces and in Ruby, from its tokens.

There is no parser: a language is a row of ``GRAMMARS`` that says which words declare what, and one pass over the tokens
keeps the open brackets with the scopes they belong to. Code that is cut short or holds placeholders gives what can be
read; brackets that don't match close what is open. Comments, strings and preprocessor lines are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache


@dataclass(frozen=True)
class Grammar:
    language: str
    #: The kind of what a word declares, if a name follows; "scope" names what is in it but is no definition of its own.
    declares: dict[str, str]
    #: Words before a bracket that call nothing.
    words: frozenset[str]
    #: Kinds in which a function is a method.
    owners: frozenset[str] = frozenset({"class", "interface"})
    #: Whether members are functions without a word (name, parameters, body), inside owners; everywhere in typed languages.
    bare: bool = False
    typed: bool = False
    #: Whether a member of an owner counts without a body; and whether one that has the owner's name does.
    bodiless: bool = False
    constructors: bool = True
    #: Whether what a word declares needs a body: a mention of a struct doesn't define it.
    bodies: frozenset[str] = frozenset()
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?")
    comments: tuple[str, ...] = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)")
    names: str = r"[^\W\d]\w*"
    more: frozenset[str] = field(default_factory=frozenset)


#: Words before a bracket that call nothing: in all languages, and in some.
CONTROL = frozenset("if for while switch catch return else case do in super this new".split())
SCRIPTED = CONTROL | set("async await delete function import instanceof throw typeof void yield".split())
COMPILED = CONTROL | set("alignof bool char decltype delete double float int long noexcept short signed sizeof static_assert throw typeof unsigned void".split())
SCRIPT = {"declares": {"class": "class", "function": "function"}, "words": SCRIPTED, "bare": True, "constructors": False, "names": r"[^\W\d$][\w$]*|\$[\w$]*", "strings": (r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?")}
NATIVE = {"words": COMPILED, "bare": True, "typed": True, "bodies": frozenset({"struct", "class", "enum", "union"}), "comments": (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"^[ \t]*#(?:\\\n|[^\n])*")}

#: The kinds that each language's declarations have.
GRAMMARS = {
    "javascript": Grammar("javascript", **SCRIPT),
    "typescript": Grammar("typescript", **{**SCRIPT, "declares": {"class": "class", "function": "function", "interface": "interface", "namespace": "scope", "module": "scope"}}, more=frozenset({"abstract"})),
    "rust": Grammar("rust", {"fn": "function", "struct": "class", "enum": "class", "union": "class", "trait": "interface", "mod": "module", "type": "class", "macro_rules": "macro", "impl": "scope"}, CONTROL | {"Err", "Ok", "Some", "fn", "loop", "match", "move", "pub", "where"}, frozenset({"class", "interface", "scope", "module"}), strings=(r'r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)', r'b?"(?:\\.|[^"\\])*"?', r"b?'(?:\\[^\n]{1,12}?|[^'\\\n])'", r"'\w+")),
    "go": Grammar("go", {"func": "function", "type": "type"}, CONTROL | {"chan", "defer", "func", "go", "interface", "range", "select"}, frozenset({"receiver"}), strings=(r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`[^`]*`?")),
    "java": Grammar("java", {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, CONTROL | {"assert", "synchronized", "throw", "try"}, frozenset({"class", "interface", "enum"}), bare=True, bodiless=True, constructors=False, strings=(r'""".*?(?:"""|\Z)', r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?")),
    "c": Grammar("c", {"struct": "class", "union": "class", "enum": "type"}, **NATIVE),
    "cpp": Grammar("cpp", {"struct": "class", "class": "class", "union": "class", "enum": "type", "namespace": "scope"}, **NATIVE, bodiless=True, more=frozenset({"namespaces"})),
    "ruby": Grammar("ruby", {"class": "class", "module": "module", "def": "method"}, CONTROL | {"and", "defined?", "elsif", "not", "or", "unless", "until", "when", "yield"}, comments=(r"#[^\n]*", r"^=begin.*?(?:^=end|\Z)"), names=r"[^\W\d]\w*[?!]?"),
}
#: What fences call the languages.
ALIASES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "rs": "rust", "golang": "go", "h": "c", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby",
}
#: Fixed value: the most bytes of a fence that are read as code.
MOST_BYTES = 256 << 10
#: Tokens between a name and its body, or in generics, brackets as one: keeps the pass linear on code that closes nothing.
LOOK = 120
#: Scopes that qualify a name, from the outermost: code nested deeper would have names as long as itself.
DEPTH = 32

CLOSES = {"(": ")", "[": "]", "{": "}"}
VALUE = re.compile(r"(?:[\w$)\]}]|\"|'|`)\Z")


def grammar(lang: str) -> Grammar | None:
    """The grammar of a fence's first word."""
    lang = lang.lower()
    return GRAMMARS.get(ALIASES.get(lang, lang))


@cache
def scanner(language: str) -> re.Pattern[str]:
    g = GRAMMARS[language]
    operators = r"=>|->|::|&&|\|\||[=!<>]=|\S"
    return re.compile(f"(?P<skip>{'|'.join(g.comments)})|(?P<string>{'|'.join(g.strings)})|(?P<name>{g.names})|(?P<number>\\d[\\w.]*)|(?P<line>\n)|(?P<sign>{operators})", re.S | re.M)


def tokens(source: str, g: Grammar) -> list[tuple[str, str, int]]:
    """(kind, text, line from 1) of each token; the ends of lines are tokens in Ruby only."""
    out: list[tuple[str, str, int]] = []
    at, line, last = 0, 1, ""
    pattern = scanner(g.language)
    regex = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n]){0,100}\]|[^/\\\n\[]){1,2000}/\w*")
    slashes = g.language in ("javascript", "typescript", "ruby")
    while m := pattern.search(source, at):
        line += source.count("\n", at, m.start())
        kind, text = m.lastgroup or "", m.group()
        if kind not in ("skip", "string", "name", "number", "line", "sign"):  # a group inside a string's pattern
            kind = "string"
        if kind == "sign" and text == "/" and slashes and (not VALUE.search(last) or last == "return") and (r := regex.match(source, m.start())):
            kind, text = "string", r.group()
        at = m.start() + len(text)
        if kind != "skip" and (kind != "line" or g.language == "ruby"):
            out.append((kind, text, line))
        if kind not in ("skip", "line"):
            last = text
        line += text.count("\n")
    return out


Found = tuple[list[tuple[str, str, int]], list[tuple[str, int]]]


def symbols(source: str, g: Grammar) -> Found:
    """((name, kind, line) defined, (name, line) called), each in the order of the code; names are qualified by what holds them."""
    if len(source.encode()) > MOST_BYTES:
        return [], []
    toks = tokens(source, g)
    return in_ruby(toks, g) if g.language == "ruby" else in_braces(toks, g)


def partners(toks: list[tuple[str, str, int]]) -> dict[int, int]:
    """The place of the bracket that closes the one at each place, the end if none does."""
    stack: list[int] = []
    out: dict[int, int] = {}
    waits = dict.fromkeys(")]}", 0)
    for i, (kind, text, _) in enumerate(toks):
        if kind == "sign" and text in CLOSES:
            stack.append(i)
            waits[CLOSES[text]] += 1
        elif kind == "sign" and waits.get(text):
            closed = ""
            while closed != text:
                closed = CLOSES[toks[stack[-1]][1]]
                out[stack.pop()] = i
                waits[closed] -= 1
    return out | dict.fromkeys(stack, len(toks))


def after_generics(toks: list[tuple[str, str, int]], i: int) -> int:
    """The place behind the angle brackets that begin at i, if any do."""
    depth = 0
    for j in range(i, min(len(toks), i + LOOK)):
        text = toks[j][1]
        depth += (text == "<") - (text == ">")
        if depth <= 0:
            return j + (text == ">" and j > i)
        if text in ("{", ";"):
            break
    return i


def path_of(toks: list[tuple[str, str, int]], i: int) -> tuple[str, int]:
    """(the dotted name that begins at i, the place behind it and its generics)."""
    parts = [toks[i][1]]
    i = after_generics(toks, i + 1)
    while i + 1 < len(toks) and toks[i][1] in ("::", ".") and toks[i + 1][0] == "name":
        parts.append(toks[i + 1][1])
        i = after_generics(toks, i + 2)
    return ".".join(parts), i


def in_braces(toks: list[tuple[str, str, int]], g: Grammar) -> Found:
    """One pass: what each declaring word, and each name with parameters and a body where functions may stand, defines."""
    ends = partners(toks)
    defined: list[tuple[str, str, int]] = []
    called: list[tuple[str, int]] = []
    scopes: dict[int, tuple[str, str]] = {}  # what the brace at a place belongs to
    open_: list[tuple[int, str, str]] = []  # (where it ends, name, kind) of the scopes around
    named: set[int] = set()  # places that define, so they don't call

    def text(i: int) -> str:
        return toks[i][1] if 0 <= i < len(toks) else ""

    def is_name(i: int) -> bool:
        return 0 <= i < len(toks) and toks[i][0] == "name"

    def body(i: int) -> int | None:
        """The brace that begins the body of what is declared before i, if it has one: past parameters, bases and results."""
        for _ in range(LOOK):
            if i >= len(toks) or text(i) in (";", "}", ")", ","):
                break
            if text(i) == "{":
                return i
            if text(i) == "=" and g.language != "rust":
                return None
            i = ends[i] + 1 if i in ends else i + 1
            if g.language == "cpp" and text(i) == ",":  # between members that a constructor sets
                i += 1
        return None

    def opens(i: int | None, name: str, kind: str) -> None:
        if i is not None:
            scopes.setdefault(i, (name, kind))

    def define(name: str, kind: str, line: int, extra: str = "") -> None:
        around = [n for _, n, _ in open_[:DEPTH] if n] + ([extra] if extra else [])
        if kind == "function" and (extra or (open_ and open_[-1][2] in g.owners) or (g.typed and "." in name)):
            kind = "method"
        defined.append((".".join([*around, name]), kind, line))

    i = 0
    while i < len(toks):
        kind, word, line = toks[i]
        while open_ and open_[-1][0] <= i:
            open_.pop()
        if kind == "sign" and word == "{":
            open_.append((ends[i], *scopes.get(i, ("", "" if i in scopes else "block"))))
        if kind != "name" or text(i - 1) in (".", "?."):
            if kind == "name" and text(i + 1) == "(" and i not in named:
                called.append((word, line))
            i += 1
            continue
        inside = open_[-1][2] if open_ else ""
        step = i + 1
        if word in g.declares:
            what, j = g.declares[word], i + 1
            receiver = ""
            if g.language == "go" and word == "func" and text(j) == "(":
                receiver = next((text(k) for k in range(ends[j] - 1, j, -1) if is_name(k) and text(k + 1) in (")", "[")), "")
                j = ends[j] + 1
            if g.language == "rust" and word == "impl":
                j = after_generics(toks, j)
                stop = next((k for k in range(j, min(len(toks), j + LOOK)) if text(k) in ("{", ";")), j)
                j = next((k + 1 for k in range(j, stop) if text(k) == "for" and text(k + 1) != "<"), j)
                while text(j) in ("&", "mut", "dyn"):
                    j += 1
            if word == "macro_rules" or text(j) == "*" or (word == "enum" and text(j) in ("class", "struct")):
                j += 1
            if g.language == "go" and word == "type" and text(j) == "(":  # a group of types
                k, stop = j + 1, ends[j]
                while k < stop:
                    if is_name(k) and toks[k][2] != toks[k - 1][2]:
                        define(text(k), what, toks[k][2])
                        opens(k + 2 if text(k + 2) == "{" else None, text(k), what)
                    k = ends.get(k, k) + 1
            if is_name(j) and text(j) not in g.declares:
                name, behind = path_of(toks, j)
                starts = body(behind)
                has_body = starts is not None
                if word in g.bodies and (not has_body or any(text(k) in ("(", "=") for k in range(behind, starts or behind))):
                    i += 1  # a mention of a type
                    continue
                signature = g.language == "rust" and word == "fn" and not has_body
                if what != "scope" and not signature and not (g.language == "rust" and word == "mod" and not has_body):
                    define(name, what, line, receiver)
                named.add(j)
                opens(starts, f"{receiver}.{name}" if receiver else name, "method" if inside in g.owners and what == "function" else what)
                step = j + 1
        elif word == "typedef" and g.typed:
            j = i + 1
            while j < min(len(toks), i + LOOK) and text(j) != ";":
                j = ends[j] + 1 if text(j) == "{" else j + 1
            last = next((k for k in range(j - 1, i, -1) if is_name(k)), None)
            if last is not None and text(j - 1) == ")" and (pointer := next((k for k in range(i, j) if text(k) == "*" and text(k - 1) == "(" and is_name(k + 1)), None)):
                last = pointer + 1  # a pointer to a function
            if last is not None:
                define(text(last), "type", toks[last][2])
        elif g.language in ("javascript", "typescript") and is_name(i) and text(i + 1) in ("=", ":") and text(i - 1) in ("const", "let", "var"):
            j = next((k for k in range(i + 1, min(len(toks), i + 40)) if text(k) in ("=", ";")), len(toks)) + 1
            j += text(j) == "async"
            arrow = next((k for k in range(ends[j] + 1, min(len(toks), ends[j] + 12)) if text(k) in ("=>", ";", ",")), -1) if j in ends else j + 1
            if text(j) == "function" or (text(arrow) == "=>" and (j in ends and text(j) == "(" or is_name(j))):
                define(word, "function", line)
                opens(arrow + 1 if text(arrow + 1) == "{" else body(j + 1) if text(j) == "function" else None, word, "function")
        else:
            name, behind = path_of(toks, i) if g.typed else (word, after_generics(toks, i + 1))
            owner = inside in g.owners
            here = g.bare and word not in g.words and text(behind) == "(" and (owner or (g.typed and inside in ("", "scope")))
            if here:
                close = ends[behind]
                starts = body(close + 1)
                before = text(i - 1)
                typed = is_name(i - 1) and before not in ("return", "else", "new", "throw") or before in ("*", "&", ">", "]")
                own = owner and name == open_[-1][1].rsplit(".", 1)[-1] or name == "constructor" and g.language != "java"
                out_of_class = g.typed and "." in name
                bare_member = owner and (starts is not None or (g.bodiless and (typed or own)) or ("abstract" in g.more and "abstract" in [text(k) for k in range(max(0, i - 4), i)]))
                at_top = not owner and starts is not None and (typed or out_of_class)
                if before == "~":
                    named.add(i)
                elif (bare_member or at_top) and before not in ("=", "(", ",", "@") and "=" not in [text(k) for k in range(close + 1, starts or close + 1)]:
                    if g.constructors or not own:
                        define(name, "function", line)
                    opens(starts, name, "function")
                    named.add(i)
                    step = behind
                    named.update(range(i, behind), range(close, starts or close))  # with what a constructor sets
                elif not owner and typed:
                    named.add(i)  # declared only
        local = g.typed and is_name(i - 1) and text(i - 1) not in g.words  # a variable and what it begins with
        local |= text(i - 1) == "@" and g.language == "java" or inside == "type" and g.language == "go"
        if i not in named and not local and word not in g.words and word not in g.declares and step == i + 1:
            j = i + 1 + (g.language == "rust" and text(i + 1) == "!")
            j = after_generics(toks, j + 1) if text(j) == "::" and text(j + 1) == "<" else j
            if text(j) in (("(", "[", "{") if text(i + 1) == "!" and g.language == "rust" else ("(",)):
                called.append((word, line))
        i = step
    return defined, called


def in_ruby(toks: list[tuple[str, str, int]], g: Grammar) -> Found:
    """As in_braces, where words open a body and ``end`` closes it."""
    defined: list[tuple[str, str, int]] = []
    called: list[tuple[str, int]] = []
    open_: list[str] = []
    begins, loop = True, False  # a statement begins here; a loop's own do is still to come
    i = 0
    while i < len(toks):
        kind, word, line = toks[i]
        after = toks[i - 1][1] if i else ""
        step = i + 1
        if kind == "line" or word == ";":
            begins, loop = True, False
            i += 1
            continue
        if kind == "name" and after not in (".", ":", "::"):
            if word in g.declares and i + 1 < len(toks) and (toks[i + 1][0] == "name" or toks[i + 1][1] == "<"):
                if toks[i + 1][1] == "<":  # the class of one object
                    open_.append("")
                else:
                    j = i + 1
                    parts = [toks[j][1]]
                    while j + 2 < len(toks) and toks[j + 1][1] in (".", "::") and toks[j + 2][0] == "name":
                        parts, j = [*parts, toks[j + 2][1]], j + 2
                    name = ".".join(p for p in parts if p != "self")
                    defined.append((".".join([*filter(None, open_[:DEPTH]), name]), g.declares[word], line))
                    k = next((k for k in range(j + 1, min(len(toks), j + LOOK)) if toks[k][0] == "line"), j + 1)
                    if word != "def" or not any(toks[m][1] == "=" and m <= j + 2 + 2 * (toks[j + 1][1] == "(") for m in range(j + 1, k) if toks[m - 1][1] == ")" or m == j + 1):
                        open_.append(name)  # not a method that is one expression
                    step = j + 1
            elif word == "do" or (begins and word in ("if", "unless", "while", "until", "for", "case", "begin")) or (word in ("if", "case", "begin") and after == "="):
                if not (word == "do" and loop):
                    open_.append("")
                loop = word in ("while", "until", "for")
            elif word == "end" and open_:
                open_.pop()
        if kind == "name" and step == i + 1 and word not in g.words and i + 1 < len(toks) and (toks[i + 1][1] == "(" or after == "."):
            called.append((word, line))
        begins = word in ("then", "else", "do")
        i = step
    return defined, called


def lines_of(rows: Found) -> Iterator[tuple[str, str, str, int]]:
    """(name, kind, role, line) of what was found."""
    yield from ((n, k, "define", line) for n, k, line in rows[0])
    yield from ((n, "call", "use", line) for n, line in rows[1])
