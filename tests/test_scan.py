"""Rows are found and ranked where they are read: nothing of a posting moves, and results equal the plain reading."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import lexical, scan


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def rows_of(spark, n):
    return spark.range(n).select(F.format_string("d#/%04d", "id").alias("anchor"), F.concat(F.lit("alpha "), F.repeat(F.lit("beta "), (F.col("id") % 3).cast("int")), F.lit("alphabet Gamma_delta")).alias("text"), F.lit("Alpha").alias("title"))


def test_grep_moves_only_the_best_rows(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "nothing"), (3, "gam")], "query_id long, query string")
    found = lexical.grep(queries, rows_of(spark, 500), 4)
    assert "Join" not in plan_of(found) and plan_of(found).count("Exchange") <= 2 * plan_of(found).count("MapInArrow")
    got = {q: [r.anchor for r in found.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert got == {1: ["d#/0002", "d#/0005", "d#/0008", "d#/0011"], 2: [], 3: ["d#/0000", "d#/0001", "d#/0002", "d#/0003"]}
    first = found.filter("query_id = 1 and rank = 1").first()
    assert (first.distinct_terms, first.occurrences) == (2, 4)


def test_bm25_ranks_in_the_task_that_reads(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma_delta"), (3, "nothing")], "query_id long, query string")
    for stemmed in (False, True):
        found = lexical.bm25(queries, rows_of(spark, 500), {"text": 1.0, "title": 3.0}, 5, stemmed=stemmed)
        assert "Join" not in plan_of(found)
        scorer = lexical.scorer(queries, lexical.index(rows_of(spark, 500), ["text", "title"], stemmed), {"text": 1.0, "title": 3.0}, stemmed)
        plain = lexical.top(scorer.scores().withColumnRenamed("key", "anchor"), 5)
        as_rows = lambda df: sorted((r.query_id, r.rank, r.anchor, r.score) for r in df.collect())
        assert as_rows(found) == as_rows(plain) and len(as_rows(found)) == 10


def test_blocks_of_queries_agree(spark, monkeypatch):
    queries = spark.range(7).select(F.col("id").alias("query_id"), F.concat(F.lit("alpha beta x"), F.col("id").cast("string")).alias("query"))
    ask = lambda: [sorted(map(tuple, f(queries, rows_of(spark, 90)).collect())) for f in (lambda q, r: lexical.grep(q, r, 3), lambda q, r: lexical.bm25(q, r, {"text": 1.0}, 3))]
    whole = ask()
    monkeypatch.setattr(scan, "BLOCK", 2)
    assert ask() == whole
    scorer = lexical.scorer(queries, lexical.index(rows_of(spark, 90), ["text"]), {"text": 1.0})
    assert len(scorer.blocks) > 1 and scorer.hits().filter("arm = 'alpha'").count() == 90


def test_passages(spark):
    lines = spark.createDataFrame([("a b a", ["a", "b", "a"]), ("b", ["b"]), ("z a", ["z", "a"])], "line string, tokens array<string>")
    rows = spark.createDataFrame([("1", "A b-a b a"), ("2", "ab a"), ("3", "x B"), ("4", None), ("5", "z"), ("6", "a b")], "anchor string, text string")
    got = {tuple(r) for r in lexical.passages(lines, rows).select("line", "anchor").collect()}
    assert got == {("a b a", "1"), ("b", "1"), ("b", "3"), ("b", "6")}


def test_best_keeps_ties_and_what_rounding_may_lift():
    best = scan.Best(1, 2, near=2e-9)
    for keys, scores in ((["e", "d", "c"], [1.0, 1.0, 1.0]), (["b", "z"], [1.0, 0.5]), (["y", "a"], [1.0 - 1e-10, 0.9])):
        s = np.array(scores)[:, None]
        best.add(pa.array(keys), s, s > 0)
    assert [r[1] for r in best.rows[0]] == ["b", "c", "y"]
    exact = scan.Best(1, 2)
    exact.add(pa.array(["b", "a", "c"]), np.array([[1.0], [1.0], [2.0]]), np.ones((3, 1), bool))
    assert [r[1] for r in exact.rows[0]] == ["c", "a"]


ODD = ["Éa ÉCOLE école a_b_ _c", "ΣΑΣ ΟΔΟΣ. σ", "İstanbul ı x", "½ ² Ⅷ 漢字かな 12ab", "\ttab\nline  two", "", None, "naïve—dash 'q'", "ǅ ß ﬁ", "__ _ a__B", "ÀÖ̀ ɏ Ɏ"]


def test_texts_are_cut_in_the_task_as_columns_have_them(spark):
    """Tokens aren't made row by row in the JVM, and are the same."""
    rows = spark.createDataFrame([(f"{k:02d}", t) for k, t in enumerate(ODD)], "anchor string, text string").coalesce(1)
    column = pa.array(ODD, pa.string())
    for clean, token, ours in ((scan.folded, X.TOKEN, X.index_tokens(F.col("text"))), (scan.lowered, X.TERM, F.regexp_extract_all(F.lower("text"), F.lit(f"({X.TERM})"), 1))):
        row, code, names = scan.tokens(column, clean, token)
        got = [[names[c].as_py() for r, c in zip(row, code, strict=True) if r == k] for k in range(len(ODD))]
        assert got == [r[0] or [] for r in rows.orderBy("anchor").select(ours).collect()]
    for stemmed in (False, True):
        words = {w for t in ODD if t for w in t.lower().split()}
        queries = spark.createDataFrame(list(enumerate(sorted(words))), "query_id long, query string")
        by_text = lexical.scorer(queries, lexical.index(rows, ["text"], stemmed, keep=False), {"text": 1.0}, stemmed)
        by_token = lexical.scorer(queries, lexical.index(rows, ["text"], stemmed), {"text": 1.0}, stemmed)
        table = lambda s: sorted((r.arm, r.key, r.dl, round(r.f, 9)) for r in s.hits().collect())
        assert table(by_text) == table(by_token) and len(table(by_text)) > 20
    assert "regexp_extract_all" not in plan_of(lexical.grep(queries, rows, 3)).split("MapInArrow")[-1]
    assert "regexp_extract_all" not in plan_of(lexical.passages(spark.createDataFrame([("a", ["a"])], "line string, tokens array<string>"), rows)).split("MapInArrow")[-1]
