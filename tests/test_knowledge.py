import json

from loomdex.operators import citations, symbols
from loomdex.sources import chats, markdown

CODE = '''# Code

```python
LIMIT = 3
class Store:
    def put(self, x):
        return helper(x)
def helper(x):
    return x
```

```console
$ tool lock --check
output
$ tool add \\
  extra
```

```rust
fn main() {}
```

Use `tool lock` often.
'''


def test_symbols(spark):
    docs = spark.createDataFrame([("a.md", CODE), ("b.md", "```python\nhelper(1)\nput(2)\nhelper(3)\n```"), ("c.md", "```py\nnot python (\n```")], "path string, text string")
    got = symbols.extract(markdown.nodes(docs))
    rows = {(r.path, r.lang, r.name, r.kind, r.role) for r in got.collect()}
    assert {("a.md", "python", "LIMIT", "constant", "define"), ("a.md", "python", "Store.put", "method", "define"), ("a.md", "cli", "tool lock", "command", "define"), ("a.md", "cli", "tool add", "command", "define"), ("a.md", "rust", "main", "function", "define"), ("c.md", "py", "", "fence", "gap")} <= rows
    uses, defs = got.filter("role = 'use'"), got.filter("role = 'define'")
    assert {(r.path, r.name, r.symbol, r.line) for r in symbols.resolve(uses.select("path", "lang", "name", "line"), defs).collect()} == {("b.md", "helper", "helper", 2), ("b.md", "put", "Store.put", 3)}
    assert {r.name for r in symbols.named_commands(defs.filter("lang = 'cli'"), markdown.nodes(docs).filter("kind = 'paragraph'").select("text")).collect()} == {"tool lock"}


def test_entities_fold(spark):
    d = spark.createDataFrame([("x", "X tag", "tag", "extracted", "b", 1), ("x", "X topic", "topic", "authored", "a", 2), ("x", "X tag", "tag", "extracted", "c", 0)], "slug string, name string, kind string, status string, path string, ord int")
    r = symbols.fold_entities(d).first()
    assert (r["name"], r.aliases, r.kind, r.status, r.doc_refs) == ("X topic", ["X tag"], "topic", "authored", ["a", "b", "c"])


def test_citation_uris_and_fetch(spark):
    u = spark.createDataFrame([("doc:a.md#s/0?lines=3-9&digest=0123456789ab&x=1",), ("doc:a.md#s/0?lines=9-3",), ("doc:a.md#s/0?digest=zz",), ("http://x",)], "uri string")
    assert [(r.anchor, r.first, r.last, r.digest, r.status) for r in citations.parse(u).collect()] == [("a.md#s/0", 3, 9, "0123456789ab", "ok"), ("a.md#s/0", None, None, None, "malformed lines"), ("a.md#s/0", None, None, None, "ok"), ("", None, None, None, "not a citation")]
    chunks = spark.createDataFrame([("a.md#s/0", "one"), ("a.md#s/t/0", "two")], "anchor string, text string")
    wanted = spark.createDataFrame([("a.md#s/t/0",), ("a.md#s/t/9",), ("a.md#s/gone/0",), ("z.md#q/0",)], "anchor string")
    assert {r.anchor: r.found for r in citations.fetch(wanted, chunks).collect()} == {"a.md#s/t/0": "a.md#s/t/0", "a.md#s/t/9": "a.md#s/t/0", "a.md#s/gone/0": "a.md#s/0"}


def test_contract_and_grounding(spark):
    c = spark.createDataFrame([("p", 1, "one two three four five [[Known#part]]"), ("p", 2, "one two three four five [[Missing]]"), ("p", 3, "short [[x]]"), ("q", 1, "a b c d e [[Known|k]]")], "path string, ord int, text string")
    t = spark.createDataFrame([("Known",)], "name string")
    got = {r.path: (r.claims, r.cited, r.dangling, r.coverage, r.holds) for r in citations.contract(c, t).collect()}
    assert got == {"p": (2, 1, 1, 0.5, False), "q": (1, 1, 0, 1.0, True)}
    g = citations.grounding(spark.createDataFrame([("p", 0.5), ("q", 1.0), ("r", 1.0)], "path string, coverage double"), spark.createDataFrame([("p", 1.0), ("q", 0.95)], "path string, entailment double"))
    assert {r.path: (r.score, r.blockers) for r in g.collect()} == {"p": (0.5, ["coverage"]), "q": (0.95, []), "r": (0.0, ["not judged"])}


def test_tasks(spark):
    hits = spark.createDataFrame([("1", 1, "a", 50), ("1", 2, "b", 60), ("2", 1, "c", 10)], "task_id string, rank int, anchor string, tokens long")
    need = spark.createDataFrame([("1", "b"), ("2", "c"), ("3", "d")], "task_id string, anchor string")
    ours = citations.context_cost(hits, need, 100)
    assert {r.task_id: (r.found, r.tokens) for r in ours.collect()} == {"1": (False, 50), "2": (True, 10), "3": (False, 0)}
    assert citations.verdict(ours, ours).first().wins == 0


def test_chat_readers(spark):
    c = json.dumps([{"uuid": "u", "name": "n", "chat_messages": [{"sender": "human", "created_at": "2026-01-01T00:00:00Z", "text": "q"}, {"sender": "assistant", "text": "a", "extra": 1}]}])
    assert [(r.conv_id, r.turn, r.role, r.text) for r in chats.claude(spark.createDataFrame([(c,)], "text string")).orderBy("turn").collect()] == [("u", 0, "user", "q"), ("u", 1, "assistant", "a")]
    node = lambda p, r, t: {"id": t, "parent": p, "message": {"author": {"role": r}, "create_time": 1.0, "content": {"content_type": "text", "parts": [t]}}}
    g = json.dumps([{"conversation_id": "g", "current_node": "n2", "mapping": {"r": {"id": "r", "parent": None, "message": None}, "n1": node("r", "user", "hi"), "n2": node("n1", "assistant", "yo"), "x": node("n1", "assistant", "old")}}])
    assert {(r.node, r.kind, r.role) for r in chats.chatgpt(spark.createDataFrame([(g,)], "text string")).collect()} == {("n1", "message", "user"), ("n2", "message", "assistant"), ("x", "abandoned_branch", "assistant")}
    m = json.dumps({"threads": [{"tid": "t", "history": [{"who": "bot", "what": "w"}]}]})
    assert [tuple(r) for r in chats.generic(spark.createDataFrame([(m,)], "text string"), "threads", "tid", "history", "who", "what").collect()] == [("t", 0, "assistant", "w")]
