"""Records, the store, gates and readers on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import chats, citations, evaluation, graph, lexical, lifecycle, retrieval, store, symbols
from loomdex.plans.search import Settings, explain, notes, search, tool
from loomdex.sources import files, html, markdown, markup, snapshots
from loomdex.streaming import watch


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Identity


def test_canonical_json_refuses_what_json_cannot_hold():
    assert X.canonical_json({"b": [1.0, 2.5, None], "a": "e\u0301"}) == '{"a":"e\u0301","b":[1,2.5,null]}'
    for bad in ({1: 2}, float("nan"), {"a": float("inf")}, object(), {"a": {1}}):
        with pytest.raises(ValueError):
            X.canonical_json(bad)


@pytest.mark.parametrize(("word", "stem"), [("technology", "technolog"), ("possibly", "possibl"), ("sensibly", "sensibl"), ("apology", "apolog"), ("running", "run"), ("happily", "happili")])
def test_stemmer_departures(word, stem):
    assert X.porter(word) == stem


def test_edge_ids_are_digests_of_json(spark):
    rows = table(spark, [("doc:a", 'doc:"b"', "cites", "wikilink", None), ("doc:a", "doc:c", "links_to", "wikilink", "a#x/0")], "s string, t string, k string, p string, a string")
    for r in rows.withColumn("id", X.edge_id(*(F.col(c) for c in "stkpa"))).collect():
        assert r.id == X.digest_of([r.s, r.t, r.k, X.digest_of({"kind": r.p, "anchor": r.a})])


def test_ulids(spark):
    u = X.encode_ulid(1_700_000_000_123, bytes(range(10)))
    assert X.decode_ulid(u) == (1_700_000_000_123, bytes(range(10))) and X.minted_ulids(3, 5, bytes(10)) == sorted(X.minted_ulids(3, 5, bytes(10)))
    assert table(spark, [(u,)], "u string").select(F.unix_millis(X.ulid_time(F.col("u")))).first()[0] == 1_700_000_000_123
    for bad in ("8" + u[1:], u[:-1], u[:-1] + "U"):
        with pytest.raises(ValueError):
            X.decode_ulid(bad)


def test_normalized_column_is_the_function(spark):
    texts = ["\ufeffa \r\nb\t\r c\u00a0\n\n", "e\u0301 x\u2003\n y ", "", "\n\n", "a\x1c\nb\x85"]
    got = table(spark, [(t,) for t in texts] + [(None,)], "t string").select(X.normalized(F.col("t"))).collect()
    assert [r[0] for r in got] == [X.normalize_text(t) for t in texts] + [None]


def test_times_and_trust(spark):
    t = table(spark, [("2026-01-02T03:04:05+02:00",), ("2026-01-02T03:04:05",), ("2026-01-02T03:04:05.5Z",)], "t string")
    assert [r[0] for r in t.select(X.rfc3339(X.instant(F.col("t")))).collect()] == ["2026-01-02T01:04:05Z", None, "2026-01-02T03:04:05.500000Z"]
    got = table(spark, [(["high", "low"],), (["odd"],), ([],)], "t array<string>").select(X.weakest_trust(F.col("t"))).collect()
    assert [r[0] for r in got] == ["low", None, None]


# Vectors, search and packing


def test_knn_without_a_direction(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [3.0, 0.0])]
    v = table(spark, data, "id long, embedding array<double>")
    got = {}
    for r in retrieval.knn(v, v, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {1: [(1, 1.0), (8, 1.0)], 2: [(2, 1.0), (1, 0.998752)], 7: [(7, 1.0)], 8: [(1, 1.0), (8, 1.0)]}
    assert retrieval.knn(v.limit(0), v, 2).count() == 0


def corpus(spark):
    docs = [(k, f"n/{k}.md", f"T{k}", "n", "c", "authored", "verified") for k in range(1, 6)]
    chunks = [("n/1.md#top/0", 1, "the queue depends on retries", 5), ("n/2.md#/0", 2, "backoff of the queue", 4), ("n/3.md#/0", 3, "lock files", 2), ("n/4.md#api/0", 4, "RetryPolicy holds the retries", 4), ("n/5.md#/0", 5, "unrelated words", 2)]
    return table(spark, docs, "doc_id int, path string, title string, namespace string, collection string, trust string, status string"), table(spark, chunks, "anchor string, doc_id int, text string, tokens int")


def test_derived_legs_add_and_do_not_promote(spark):
    docs, chunks = corpus(spark)
    edges = table(spark, [("e1", "doc:n/1.md", "doc:n/2.md", "links_to"), ("e2", "doc:n/1.md#top", "doc:n/5.md", "links_to")], "edge_id string, source string, target string, type string")
    syms = table(spark, [("sym:python:RetryPolicy", ["n/4.md#api/0"]), ("sym:cli:uv lock", ["n/3.md#/0"])], "symbol string, doc_refs array<string>")
    q = table(spark, [(1, "what depends on backoff retries"), (2, "RetryPolicy words"), (3, "uv lock")], "query_id int, query string")
    plain = {(r.query_id, r.anchor) for r in search(q, docs, chunks, Settings(stems=False)).collect()}
    got = search(q, docs, chunks, Settings(stems=False, symbols=True, graph=True), symbols=syms, edges=edges).collect()
    assert plain <= {(r.query_id, r.anchor) for r in got}
    legs = {(r.query_id, r.anchor): list(r.legs) for r in got}
    assert legs[3, "n/3.md#/0"] == ["lexical", "symbol"]  # the command line's symbols may be found twice
    assert legs[2, "n/4.md#api/0"] == ["lexical"]
    assert all("graph" not in v for v in legs.values() if "lexical" in v)


def test_notes_and_explain(spark):
    docs, chunks = corpus(spark)
    q = table(spark, [(1, "what is the queue " + "word " * 70), (2, "zzz")], "query_id int, query string")
    got = {r.query_id: r.notes for r in notes(q, Settings(graph=True)).collect()}
    assert any("not read" in n for n in got[1]) and any("function words" in n for n in got[1]) and any("graph leg" in n for n in got[2])
    rows = {r.query_id: r for r in explain(table(spark, [(1, "queue retries zzz")], "query_id int, query string"), docs, chunks).collect()}
    terms = {t.term: t for t in rows[1].terms}
    assert terms["zzz"].unmatched and terms["queue"].documents == 2 and rows[1].candidates[0].legs == ["lexical"] and rows[1].settings.startswith("sha256:")


def test_tool_bounds_and_budget(spark):
    docs, chunks = corpus(spark)
    cited = chunks.withColumn("first", F.lit(1)).withColumn("last", F.lit(2)).withColumn("chunk_digest", X.digest(F.col("text")))
    q = table(spark, [(1, "queue retries")], "query_id int, query string")
    got = tool(q, docs, cited, budget=5).orderBy("rank").collect()
    assert [r.omitted for r in got].count(False) == 1 and got[0].uri.startswith("doc:n/") and not got[0].exceeded
    assert all(r.omitted and r.exceeded for r in tool(q, docs, cited, budget=1).collect())
    for bad in ({"k": 0}, {"k": 51}, {"budget": 0}, {"include_text": "some"}):
        with pytest.raises(ValueError):
            tool(q, docs, cited, **bad)


def test_search_modes(spark):
    rows = table(spark, [("a", "retry the queue"), ("b", "retry policy"), ("c", "queueing retries_now")], "anchor string, text string")
    q = table(spark, [(1, "retry queue")], "query_id int, query string")
    hit = lambda **how: {r.anchor for r in lexical.bm25(q, rows, {"text": 1.0}, 9, **how).collect()}
    assert hit() == {"a", "b"} and hit(mode="all") == {"a"} and hit(mode="prefix") == {"a", "b", "c"}
    with pytest.raises(ValueError):
        hit(mode="some")


def test_grep_matches_the_beginnings_of_words(spark):
    rows = table(spark, [("a", "Retrying retry un-retry"), ("b", "unretry"), ("c", "re try")], "anchor string, text string")
    got = lexical.grep(table(spark, [(1, "retry")], "query_id int, query string"), rows, 9).collect()
    assert [(r.anchor, r.occurrences) for r in got] == [("a", 3)]


# Graph


def test_source_stem_fragment_and_files(spark):
    docs = table(spark, [("knowledge/a.md",), ("knowledge/b.md",)], "path string")
    sources = table(spark, [("knowledge/a.md", "file:Docs/Guide/one.html"), ("knowledge/b.md", "docs/two.html"), ("knowledge/x.md", "https://e.org/x")], "path string, source_uri string")
    links = table(spark, [("knowledge/a.md", 1, "../two.html#Part", "markdown_link"), ("knowledge/a.md", 2, "pic.png", "image"), ("knowledge/a.md", 3, "b.md", "wikilink"), ("knowledge/a.md", 4, "b.md", "markdown_link")], "path string, ord long, target string, kind string")
    got = graph.resolve(links, docs.filter("path <> ''"), sources=sources, files=table(spark, [("knowledge/pic.png",)], "path string"))
    assert {r.ord: (r.to_path, r.reason) for r in got.collect()} == {1: ("knowledge/b.md", "resolved"), 2: (None, "not a document"), 3: ("knowledge/b.md", "resolved"), 4: ("knowledge/b.md", "resolved")}
    parts = graph.fragments(got.filter("ord = 1"), table(spark, [("knowledge/b.md", "part")], "path string, slug string"), X.slug(F.col("_fragment")))
    assert graph.edges(parts).first().target == "doc:knowledge/b.md#part"
    assert graph.fragments(got.filter("ord = 1"), table(spark, [("knowledge/b.md", "other")], "path string, slug string"), X.slug(F.col("_fragment"))).first().reason == "no such heading"


def test_overlapping_names_and_declarers(spark):
    names = table(spark, [("ab", "alpha beta"), ("bc", "beta gamma"), ("abc", "alpha beta gamma"), ("cd", "gamma delta")], "slug string, name string")
    rows = table(spark, [("d", "d/0", 0, "alpha beta gamma delta", "text"), ("e", "e/0", 0, "beta gamma", "code")], "doc_id string, anchor string, ordinal int, text string, kind string")
    assert {r.slug for r in graph.entity_mentions(names, rows).collect()} == {"ab", "bc", "abc", "cd"}
    assert {r.slug for r in graph.entity_mentions(names, rows, overlapping=False).collect()} == {"abc"}
    declared = table(spark, [("abc", "d")], "slug string, doc_id string")
    assert graph.entity_mentions(names, rows, declared=declared, overlapping=False).count() == 0


# Symbols and entities

NOTE = """# 1.2 uv.lock

Term
: what it means

`uv sync` is named.

## How retries work

```bash
X=1
uv sync --all
  indented
uv add x \\
 more
```
"""


def test_symbols_of_prose(spark):
    nodes = markdown.nodes(table(spark, [("a.md", NOTE), ("b.md", "## uv.lock output\n")], "path string, text string"))
    rows = {(r.path, r.lang, r.name, r.source, r.role, r.direct) for r in symbols.extract(nodes).collect()}
    assert ("a.md", "doc", "uv.lock", "heading", "define", True) in rows and ("b.md", "doc", "uv.lock", "heading", "define", False) in rows
    assert ("a.md", "doc", "Term", "definition_list", "define", True) in rows and ("a.md", "cli", "uv sync", "console_session", "define", True) in rows and ("a.md", "cli", "uv sync", "code_span", "use", True) in rows
    assert not any(r[2] == "indented" for r in rows)
    folded = {r.symbol: r.defined_in for r in symbols.fold(symbols.extract(nodes)).collect()}
    assert folded["sym:doc:uv.lock"] == "a.md#L1" and "sym:cli:uv sync" in folded and "sym:cli:uv add" not in folded and "sym:cli:uv add x" not in folded
    kinds = {(r.type, r.target) for r in symbols.symbol_edges(symbols.extract(nodes)).collect()}
    assert ("defines", "sym:doc:Term") in kinds and ("defines", "sym:cli:uv sync") in kinds


def test_prompts():
    assert symbols.prompted("  $ uv sync") == "uv sync" and symbols.prompted("PS C:\\> dir x") == "dir x" and symbols.prompted("$") is None and symbols.prompted("plain $ x") is None


def test_entities_are_declared(spark):
    docs = table(spark, [("b.md", "Retry Guide", ["#Queues", "2024", " "], ["Backoff"], "ingested"), ("a.md", "Other", ["queues"], [], "authored")], "path string, title string, tags array<string>, aliases array<string>, origin string")
    got = {r.slug: r for r in symbols.fold_entities(symbols.declare_entities(docs)).collect()}
    assert set(got) == {"queues", "retry-guide"} and got["queues"].status == "authored" and got["queues"]["name"] == "queues" and got["queues"].aliases == ["Queues"]
    assert got["retry-guide"].kind == "topic" and got["retry-guide"].aliases == ["Backoff"] and len(got["queues"].entity_id) == 26


# Ingestion and lifecycle

KEY = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nabc=\n-----END RSA PRIVATE KEY-----"


def test_private_keys_are_found_and_redacted(spark):
    rows = table(spark, [(1, f"before\n{KEY}\nafter"), (2, "the line -----BEGIN PRIVATE KEY----- in prose"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.rule, r.found) for r in lifecycle.secrets(rows).collect()] == [(1, "private-key", 1)]
    got = {r.doc_id: r.t for r in rows.select("doc_id", lifecycle.redacted(F.col("text")).alias("t")).collect()}
    assert got == {1: "before\n[redacted: private-key]\nafter", 2: rows.collect()[1].text, 3: None}


def test_archives(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../up.txt", "x")
    rows = table(spark, [("a", bytearray(data.getvalue())), ("b", bytearray(b"no zip"))], "archive string, content binary")
    members = lifecycle.members_of(rows)
    assert {r.archive: r.refused for r in lifecycle.archive_guard(members.filter("name is not null")).collect()} == {"a": "path escapes"}
    assert members.filter("name is null").first().archive == "b"


def test_demotion_clears_the_stamp(spark):
    docs = table(spark, [("k/verified/a.md", "verified", "me"), ("k/verified/b.md", "verified", "me"), ("k/candidate/b.md", "candidate", None)], "path string, status string, verified_by string")
    got = {r.path: (r.status, r.verified_by) for r in lifecycle.demote(docs, docs.select("path")).collect()}
    assert got == {"k/candidate/a.md": ("candidate", None), "k/verified/b.md": ("verified", "me"), "k/candidate/b.md": ("candidate", None)}


def test_markup():
    assert markup.strip_markup("a <b>bold</b> <retries> <img src='x' alt> `<b>` <!-- no --> z </p>") == "a bold <retries>  `<b>`  z"
    assert markup.strip_markup("1 < 2 and x>y") == "1 < 2 and x>y" and markup.strip_markup("<a href=u>l</a>") == "l"


def test_registry_of_parsers():
    r = markup.Registry()
    r.add("mine", {"text/x"}, str)
    r.add("built", {"text/x", "text/y"}, str, built_in=True)
    assert r.for_media("text/x")[0] == "built" and r.names() == ["built", "mine"]
    with pytest.raises(ValueError):
        r.add("built", set(), str)
    with pytest.raises(LookupError):
        r.for_media("text/z")


def test_html_bytes(spark):
    rows = table(spark, [(bytearray("é".encode("cp1252")),), (bytearray("\ufeffé".encode()),), (bytearray(b"<meta charset=latin-1>\xe9"),)], "c binary")
    assert [(r.d.text[-1], r.d.rule) for r in rows.select(html.decoded(F.col("c")).alias("d")).collect()] == [("é", "fallback"), ("é", "bom"), ("é", "declared")]


def test_long_blocks_are_cut():
    code = "```py\n" + "\n".join(f"x = {k}" for k in range(200)) + "\n```"
    rows = "| a | b |\n|---|---|\n" + "\n".join(f"| {k} | v |" for k in range(200))
    for text in (code, rows, "\n".join(f"- item {k}" for k in range(300))):
        got = markdown.chunk("p", markdown.parse(text), 100, 100)
        assert len(got) > 3 and max(c["tokens"] for c in got) <= 130
    assert all(c["text"].startswith("| a | b |\n|---|---|") for c in markdown.chunk("p", markdown.parse(rows), 100, 100))


def test_callouts():
    assert markdown.callout("[!Note] Title ") == ("note", "Title") and markdown.callout("[!x-y]") == ("x-y", "") and markdown.callout("[x] y") is None and markdown.callout("[!a b] c") is None


def test_files(spark, tmp_path):
    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# a")
    (tmp_path / "in" / "node_modules" / "b.md").write_text("# b")
    assert [r.path for r in files.scan(spark, str(tmp_path / "in")).collect()] == ["a.md"]
    got = files.acquire(spark, str(tmp_path / "in"), [str(tmp_path)], largest=2).collect()
    assert {r.warning for r in got} == {"too large"} and all(r.content is None for r in got)
    with pytest.raises(PermissionError):
        files.acquire(spark, "/etc", [str(tmp_path)])
    cases = table(spark, [("c1", "q"), ("c1", "r")], "case_id string, query string")
    with pytest.raises(ValueError):
        files.write_cases(cases, str(tmp_path / "cases"))
    torn = {"documents": table(spark, [(1, 2)], "doc_id int, chunks int"), "chunks": table(spark, [("a", 1)], "anchor string, doc_id int")}
    with pytest.raises(ValueError):
        files.export_bundle(torn, {"documents": ["doc_id"]}, str(tmp_path / "bundle"))


def test_snapshots_keep_a_journal(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "s"))
    one, two = s.publish({"t": table(spark, [(1,)], "a int")}), s.publish({"t": table(spark, [(2,)], "a int")})
    s.rollback(one)
    assert s.current() == one and [(j["action"], j["snapshot"]) for j in s.journal()] == [("publish", one), ("publish", two), ("rollback", one)]


def test_rescan_sees_edits(spark, tmp_path):
    folder, state = tmp_path / "w", str(tmp_path / "state")
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.md").write_text(name)
    watch.watch_folder(spark, str(folder), "*.md", state, str(tmp_path / "cp")).awaitTermination()
    (folder / "a.md").write_text("edited")
    (folder / "b.md").unlink()
    (folder / "d.md").write_text("d")
    got = {r.path.rsplit("/", 1)[1]: r.action for r in watch.rescan(spark, str(folder), "*.md", state).collect()}
    assert got == {"a.md": "edited", "b.md": "removed", "d.md": "new"}
    assert watch.latest(spark, state).count() == 3


# Evaluation


def test_gates(spark):
    ours = table(spark, [(f"c{k}", 0.5) for k in range(60)], "case_id string, ndcg double")
    blessed = table(spark, [(f"c{k}", 0.6) for k in range(60)], "case_id string, ndcg double")
    slices = table(spark, [(f"c{k}", "big") for k in range(58)] + [("c1", "few"), ("c2", "unanswerable")], "case_id string, slice string")
    got = {r.slice: (r.armed, r.moved, r.passed) for r in evaluation.gate_regression(ours, blessed, slices).collect()}
    assert got == {"big": (True, True, False), "few": (False, True, True), "unanswerable": (False, True, True)}
    assert all(r.passed for r in evaluation.gate_regression(ours, blessed, slices, same_corpus=False).collect())
    r = evaluation.gate_hybrid(ours, blessed, slices).first()
    assert r.earns and r.delta == 0.2 and not evaluation.gate_hybrid(blessed, ours, slices).first().earns
    cov = table(spark, [("c", 1.0, 0.5, 3, False), ("d", 0.9, 1.0, 0, True)], "case_id string, coverage double, precision double, cited_tokens long, abstained boolean")
    assert not evaluation.gate_citations(cov).first().passed and evaluation.citation_summary(cov).first().cited_tokens == 3


def test_latency_of_one_hot_group(spark):
    rows = table(spark, [("g", float(k)) for k in range(1000)] + [("h", 5.0)] * 500 + [("g", None)], "grp string, v double")
    assert {r.grp: (r.n, r.p50, r.p95) for r in evaluation.latency(rows, "grp", "v", parts=16).collect()} == {"g": (1000, 500.0, 949.0), "h": (500, 5.0, 5.0)}


def test_window_reads(spark):
    sections = table(spark, [("d", k, 10) for k in range(10)] + [("s", 0, 5), ("s", 1, 5)], "doc string, ord int, tokens int")
    hits = table(spark, [("t", "d", 8), ("t", "s", 1), ("u", "d", 2)], "task_id string, doc string, ord int")
    assert {(r.task_id, r.doc): (r.first, r.last, r.tokens) for r in citations.window_reads(sections, hits, 35).collect()} == {("t", "d"): (7, 9, 30), ("t", "s"): (0, 1, 10), ("u", "d"): (2, 4, 30)}


def test_fetch_modes(spark):
    chunks = table(spark, [("a.md#s/0", "one"), ("a.md#s/1", "two"), ("a.md#t/0", "three")], "anchor string, text string")
    wanted = table(spark, [("a.md#s/7",)], "anchor string")
    assert [citations.fetch(wanted, chunks, m).first().text for m in ("chunk", "section", "document")] == ["one", "one\n\ntwo", "one\n\ntwo\n\nthree"]


# Chats


def test_turns_of_transcripts(spark):
    def lines(doc, text):
        return [(doc, n, x) for n, x in enumerate(text.split("\n"))]

    rows = lines("call", "intro\n> [!user]\n> hi\n\nafter\n> [!assistant] (gpt-x)\n> yo") + lines("head", "## 1 · User\nq\n## 2 · Assistant\na\nUser: not this") + lines("bold", "**User:** one\nmore\nAssistant: two")
    got = {}
    for r in chats.marked_turns(table(spark, rows, "doc string, n int, line string")).orderBy("doc", "seq").collect():
        got.setdefault(r.doc, []).append((r.role, r.model, r.text))
    assert got["head"] == [("user", None, "q"), ("assistant", None, "a\nUser: not this")]
    assert got["bold"] == [("user", None, "one\nmore"), ("assistant", None, "two")]
    assert got["call"] == [("fragment", None, "intro"), ("user", None, "hi"), ("assistant", "gpt-x", "yo")]


def test_pastes(spark):
    rows = [("a", 0, "before"), ("a", 1, "You: hi"), ("a", 2, "there"), ("a", 3, "ChatGPT said: yo"), ("b", 0, "You: only one"), ("b", 1, "x")]
    got = [(r.doc, r.role, r.text, r.reason) for r in chats.pasted(table(spark, rows, "doc string, n int, line string")).orderBy("doc", "seq").collect()]
    assert got == [("a", "fragment", "before", "preamble"), ("a", "user", "hi\nthere", None), ("a", "assistant", "yo", None), ("b", "fragment", "You: only one\nx", "unsegmented_paste")]


def test_long_branches(spark):
    n = 300
    nodes = table(spark, [("c", str(k), str(k - 1) if k else None) for k in range(n)] + [("c", "x", "5")], "conv_id string, node string, parent string")
    got = chats.branch(nodes, table(spark, [("c", str(n - 1))], "conv_id string, node string"))
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"message": n, "abandoned_branch": 1}


def test_segmentation_and_archive(spark):
    lines = table(spark, [("d", k, f"l{k}") for k in range(4)], "doc string, n int, line string")
    ok = table(spark, [("d", [(0, "user"), (2, "assistant")], 4)], "doc string, turns array<struct<line:int,role:string>>, lines int")
    assert [(r.role, r.text) for r in chats.segmented(lines, ok).orderBy("seq").collect()] == [("user", "l0\nl1"), ("assistant", "l2\nl3")]
    a = table(spark, [("C1", "s1", "p")], "conv_id string, source_digest string, project string")
    again = chats.archived(chats.archived(a, a), table(spark, [("C2", "s2", "p"), ("C3", "s2", "p")], "conv_id string, source_digest string, project string"))
    assert again.count() == 2
    gone = chats.purged({"archive": a, "custody": table(spark, [("s1",), ("s9",)], "digest string")}, a.select("conv_id"), custody=True)
    assert gone["archive"].count() == 0 and [r.digest for r in gone["custody"].collect()] == ["s9"]
    text = chats.projected(table(spark, [("c", 1, "user", "# title\nbody\n---")], "conv_id string, seq int, role string, text string")).first().text
    assert text == "## 1 · user\n\n\\# title\nbody\n\\---\n"


# The store


def test_store(spark):
    tables = {"documents": table(spark, [(1, "a"), (2, "b")], "doc_id int, path string"), "chunks": table(spark, [("a#/0", 1), ("b#/0", 2)], "anchor string, doc_id int"), "edges": table(spark, [("e",)], "edge_id string")}
    left = store.delete_documents(tables, table(spark, [(1,)], "doc_id int"))
    assert left["chunks"].count() == 1 and left["edges"].count() == 1
    with pytest.raises(ValueError):
        store.replace(tables, nothing=tables["edges"])
    v = store.put_vectors(table(spark, [("d", "m", [1.0])], "chunk_digest string, model_id string, vector array<float>"), table(spark, [("d", "m", [2.0]), ("e", "m", [3.0])], "chunk_digest string, model_id string, vector array<float>"))
    assert {r.chunk_digest: list(r.vector) for r in v.collect()} == {"d": [2.0], "e": [3.0]} and store.has_vectors(v, "m") and not store.has_vectors(v, "n")
    texts = table(spark, [("d", "ab"), ("e", "abcd")], "chunk_digest string, text string")
    got = store.embed(texts, lambda: lambda ts: [[len(t), 0.0] for t in ts], "m", 2).collect()
    assert {r.chunk_digest: list(r.vector) for r in got} == {"d": [1.0, 0.0], "e": [1.0, 0.0]}
    assert store.chunk_at(tables["chunks"], table(spark, [("zz",)], "anchor string")).first().doc_id is None
