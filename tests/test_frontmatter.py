"""Frontmatter as columns, and projections that read back."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.functions import text as X
from loomdex.sources import frontmatter, projection

GOOD = X.encode_ulid(1, b"\xff" * 10)


def test_rows(spark):
    texts = [
        ("a", f"---\nid: {GOOD}\ntitle: 3\ntags: [x, 2, yes]\naliases: one\ngrounding: 0.5\nverified_at: 2026-01-02\norigin: ingested\nmood: {{a: [1]}}\n---\nbody\n"),
        ("b", "---\nid:\n---\nx"), ("c", "---\norigin: other\ngrounding: 3\nsource_digest: sha256:zz\nverified_at: soon\ntitle: [1]\n---\nx"), ("d", "plain"), ("e", "---\n- list\n---\nx"), ("f", "---\na: &x 1\nb: *x\n---\nx"), ("g", None),
    ]
    got = {r.path: r for r in frontmatter.frontmatter(spark.createDataFrame(texts, "path string, text string")).collect()}
    a = got["a"]
    assert (a.id, a.title, a.tags, a.aliases, a.grounding, a.verified_at, a.origin, a.properties, a.body) == (GOOD, "3", ["x", "2"], ["one"], 0.5, datetime.date(2026, 1, 2), "ingested", '{"mood": {"a": [1]}}', "body\n")
    assert len(a.warnings) == 1 and "ULID" in got["b"].error and len(got["c"].warnings) == 5 and got["c"].error is None
    assert got["d"].body == "plain" and got["e"].error and "alias" in got["f"].error and got["g"].body == ""


def test_stamps(spark):
    rows = spark.createDataFrame([("a", "---\r\nb: 1\r\n---\r\nx\r\n", "v"), ("c", "text", "v"), ("d", "---\na: [\n---\nx", "v")], "path string, text string, who string")
    got = {r.path: (r.text, r.refused) for r in frontmatter.stamped(rows, "verified_by", "who").collect()}
    assert got["a"][0] == "---\r\nb: 1\r\nverified_by: v\r\n---\r\nx\r\n" and got["c"][0] == "---\nverified_by: v\n---\ntext" and got["d"][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["h1", "h2", "p", "li", "blockquote"]), st.text("ab1.#->*+=`|) ", min_size=1, max_size=12).map(lambda t: f"w {t.strip()}".strip())), max_size=6))
def test_projections_read_back(blocks):
    held = {"title": "A: b", "source": "file:x"}
    assert projection.reads_back(projection.project(held, blocks), held, blocks) is None


def test_projection_rows(spark):
    sources = spark.createDataFrame([(1, "evidence/a.md", "Title: x", "ingested")], "key int, path string, title string, origin string")
    blocks = spark.createDataFrame([(1, 1, "p", "# not a heading"), (1, 0, "h1", "A heading"), (1, 2, "li", "one"), (1, 3, "li", "1. two"), (1, 4, "pre", "x = 1")], "key int, ord int, kind string, text string")
    r = projection.projections(sources, blocks).first()
    assert r.problem is None and r.text == "---\ntitle: 'Title: x'\norigin: ingested\n---\n\n# A heading\n\n\\# not a heading\n\n- one\n- 1\\. two\n\n```\nx = 1\n```\n"
