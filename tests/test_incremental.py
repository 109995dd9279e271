"""An incremental build has the tables of a build from nothing, and makes again only what a change reaches."""

from loomdex.corpus import Corpus
from loomdex.operators import lifecycle
from loomdex.plans.build import compile_documents
from tests.test_corpus import FILES

MORE = {
    "notes/far.md": "# Far\n\nNothing of that here. See [retry](../verified/retry.md#policy).\n",
    "notes/code.md": "# Code\n\n```python\nclass Box:\n    def open(self):\n        pass\n```\n",
    "notes/user.md": "# User\n\n```python\nBox.open()\nagain(2)\n```\n\nWork lines are long work lines indeed.\n",
    "evidence/deep/other.md": "---\norigin: ingested\nsource: file:docs/deep/other.html\n---\n# Other\n\nBack to [it](../source.md) and [so](../source.html).\n",
}
HEADING = {"verified/retry.md": FILES["verified/retry.md"].replace("## Policy", "## Rules")}
#: Each step: what is written and what goes; the documents that are made again, and those whose references are looked up again though they aren't.
STEPS = [
    # a heading, which links name and whose document defines a function that others use
    (HEADING, [], {"verified/retry.md"}, {"notes/far.md", "verified/queue.md", "notes/plain.md", "notes/user.md"}),
    # an id becomes free; an alias, a tag and a name appear, of which one makes another ambiguous; definitions and a source go
    (
        {
            "notes/new.md": "---\naliases: [nowhere]\ntags: [long work]\n---\n# New\n", "notes/code.md": "# Code\n\nNo code.\n", "notes/sub/retry.md": "# A second of that name\n",
            "evidence/source.md": FILES["evidence/source.md"].replace("docs/source.html", "docs/moved.html"), "notes/bad.md": "# Good now\n",
        },
        ["notes/twin.md"], {"verified/queue.md", "notes/new.md", "notes/code.md", "notes/sub/retry.md", "evidence/source.md", "notes/bad.md"}, None,
    ),
]


def observed(tables):
    return {r.name: (r.rows, r.digest) for r in lifecycle.observe({n: t for n, t in tables.items() if n != "build"}).collect()}


def docs_of(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, text string").repartition(3)


def test_equal_to_a_cold_build(spark, tmp_path):
    files = {**FILES, **MORE}
    c = Corpus(spark, str(tmp_path / "s"))
    c.build(docs_of(spark, files))
    for write, remove, made, looked in STEPS:
        files = {k: v for k, v in files.items() | write.items() if k not in remove and write.get(k, v) == v}
        docs = docs_of(spark, files)
        c.build(docs)
        cold = compile_documents(docs, c.table("documents").first().env_digest)
        warm = {n: c.table(n) for n in cold}
        got, want = observed(warm), observed(cold)
        assert {n for n in want if got[n] != want[n]} == set(), (write, remove)
        build = c.table("build").collect()
        bad = {r.path for r in c.table("quarantine").collect()}
        assert {r.path for r in build if r.action in ("new", "rebuilt")} == made - bad, write
        assert {r.path for r in build if r.action == "removed"} == {p for p in remove if p not in bad}
        if looked is not None:
            assert {r.path for r in build if r.resolved} - made == {p for p in looked if p not in bad}, write


def test_other_settings_rebuild_all(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "s"))
    docs = docs_of(spark, MORE)
    c.build(docs)
    c.build(docs, config={"chunk": 2})
    assert {r.action for r in c.table("build").collect()} == {"rebuilt"}
    c.build(docs, config={"chunk": 2})
    assert {(r.action, r.resolved) for r in c.table("build").collect()} == {("reused", False)}


def test_a_build_on_another_writers(spark, tmp_path):
    """A publication in between: the build starts again on top of it."""
    c, other = Corpus(spark, str(tmp_path / "s")), Corpus(spark, str(tmp_path / "s"))
    first = c.build(docs_of(spark, MORE))
    commit, once = c.snapshots._commit, []

    def late(make):
        if not once:
            once.append(other.build(docs_of(spark, {**MORE, "x.md": "# X\n"})))
        return commit(make)

    c.snapshots._commit = late
    last = c.build(docs_of(spark, {**MORE, "y.md": "# Y\n"}))
    assert c.snapshots.manifest(last)["parent"] == once[0] and c.snapshots.manifest(once[0])["parent"] == first
    paths = {r.path for r in c.table("documents").collect()}
    assert "y.md" in paths and "x.md" not in paths
