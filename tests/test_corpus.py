"""A small corpus from files to answers."""

import pytest

from loomdex.corpus import Corpus
from loomdex.functions import text as X

ULID = X.encode_ulid(7, b"\xff" * 10)
FILES = {
    "verified/queue.md": f"---\nid: {ULID}\ntitle: Queues\ntags: [queues]\naliases: [Work lines]\n---\n# The queue\n\nA queue holds requests until backoff ends. See [[retry#Policy]] and [notes](../notes/plain.md).\n\n## uv.lock\n\nIt locks.\n",
    "verified/retry.md": "# Retry\n\n## Policy\n\nRetries go to the work lines of a queue. `uv sync` runs them.\n\n```python\ndef again(x):\n    return x\n```\n",
    "notes/plain.md": "---\nsupersedes: retry\n---\nPlain words about requests. See [[nowhere]].\n\n```python\nagain(1)\n```\n\n```bash\nuv sync --all\n```\n",
    "evidence/source.md": "---\norigin: ingested\nsource: file:docs/source.html\n---\n# Source\n\nQueues are described here.\n",
    "candidate/summary.md": "---\norigin: synthesized\n---\n# Summary\n\nRequests wait in line for their turn [[source]].\n",
    "notes/twin.md": f"---\nid: {ULID}\n---\n# Twin\n",
    "notes/bad.md": "---\nid: not-one\n---\n# Bad\n",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (folder / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / "in" / name).write_text(text)
    c = Corpus(spark, str(folder / "store"))
    c.build(str(folder / "in"))
    c.folder = folder
    return c


def test_documents(corpus):
    docs = {r.path: r for r in corpus.table("documents").collect()}
    assert set(docs) == {n for n in FILES if n not in ("notes/bad.md", "verified/queue.md", "notes/twin.md")} | {"notes/twin.md"}
    # of two paths with one id the first by name keeps it
    assert docs["notes/twin.md"].doc_id == ULID and docs["verified/retry.md"].doc_id.startswith("0" * 10)
    assert (docs["candidate/summary.md"].status, docs["evidence/source.md"].trust, docs["verified/retry.md"].title) == ("candidate", "ingested", "Retry")
    assert {r.path for r in corpus.table("quarantine").collect()} == {"notes/bad.md", "verified/queue.md"}


def test_edges(corpus):
    edges = {(r.source, r.target, r.type, r.status) for r in corpus.table("edges").collect()}
    assert ("doc:candidate/summary.md", "doc:evidence/source.md", "cites", "authored") in edges
    assert ("doc:candidate/summary.md", "doc:evidence/source.md", "derived_from", "authored") in edges
    assert ("doc:notes/plain.md", "doc:verified/retry.md", "supersedes", "authored") in edges
    assert ("doc:notes/plain.md", "sym:python:again", "references", "extracted") in edges and ("doc:verified/retry.md", "sym:python:again", "defines", "extracted") in edges
    assert ("notes/plain.md", "nowhere", "no such document") in {tuple(r) for r in corpus.table("warnings").collect()}


def test_questions(spark, corpus):
    q = spark.createDataFrame([("a", "retries of a queue"), ("b", "zzz")], "query_id string, query string")
    hits = corpus.search(q).collect()
    assert {r.query_id for r in hits} == {"a"} and hits[0].anchor.startswith("verified/retry.md#")
    near = corpus.neighbors(spark.createDataFrame([("notes/plain.md",), ("gone.md",), ("sym:python:again",)], "target string"), depth=1).collect()
    assert ("gone.md", None, "no such document") in {(r.target, r.node, r.error) for r in near}
    assert ("notes/plain.md", "doc:verified/retry.md") in {(r.target, r.node) for r in near} and ("sym:python:again", "doc:verified/retry.md") in {(r.target, r.node) for r in near}
    assert {r.check: r.status for r in corpus.doctor().collect()}["sources in quarantine"] == "warning"


def test_life(spark, corpus):
    first = corpus.snapshots.current()
    plan = {r.path: r.action for r in corpus.plan(str(corpus.folder / "in")).collect()}
    assert plan["verified/retry.md"] == "reused" and plan["verified/queue.md"] == "quarantined"
    entailed = spark.createDataFrame([("candidate/summary.md", 0.99)], "path string, entailment double")
    scores = corpus.verify(entailed)
    assert scores.first().blockers == [] and scores.first().score == 0.99
    corpus.promote(scores, "me", "2026-01-01")
    assert {r.path: r.status for r in corpus.table("documents").collect()}["verified/summary.md"] == "verified"
    corpus.demote(spark.createDataFrame([("verified/summary.md",)], "path string"))
    assert "candidate/summary.md" in {r.path for r in corpus.table("documents").collect()}
    corpus.export(str(corpus.folder / "out"))
    assert spark.read.text(str(corpus.folder / "out" / "documents")).count() == 5
    with pytest.raises(ValueError):
        corpus.export(str(corpus.folder / "other"), spark.createDataFrame([("a", "b")], "path string, source_digest string"))
    corpus.snapshots.rollback(first)
    assert corpus.snapshots.current() == first


def test_evaluation(spark, corpus):
    anchor = corpus.search(spark.createDataFrame([("a", "backoff retries queue")], "query_id string, query string")).first().anchor
    cases = spark.createDataFrame([("c", "backoff retries queue", True, [(anchor, 3)])], "case_id string, query string, answerable boolean, relevant array<struct<anchor:string,grade:int>>")
    assert corpus.evaluate(cases).first().ndcg == 1.0
