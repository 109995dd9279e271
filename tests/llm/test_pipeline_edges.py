"""The pipeline's stages on nulls, ties, repeated rows, very long texts and columns whose names clash; repeated rows and long
texts in the operators that they call."""

import random

import pytest

import corpus_pipeline
from loomdex.llm import linededup, substring

from .test_operators import brute_lines, brute_windows, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _version long, size string, fp double, score string, copies int, _lang string"
REST = (5, "big", 0.5, "s", 9, "xx")


def make(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(900)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(20_000))
    short = "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(6))
    data = [(1, long, "en", "a"), (2, long + " more", "en", "b"), (3, short, "en", None), (3, short, "en", None), (None, short, "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, "12 34", "en", "a"), (7, "été là", "fr", "b"), (8, "a b c d e f", "en", "c")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *REST) for i, t, lang, s in data], SCHEMA).repartition(3)


def test_stages_pass_columns_through(spark):
    docs = make(spark)
    held = {"language ID": {1, 2, 3, None, 7, 8}, "line dedup": {1, 2, 3, 7, 8}, "SimHash near-dedup": {1, 2, 3, 7, 8}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [part.split(" ")[0] for part in SCHEMA.split(", ")]
        got = docs.collect()
        assert all((r._version, r.size, r.fp, r.score, r.copies, r._lang) == REST for r in got)
        if name in held:
            assert {r.doc_id for r in got} <= held[name]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_near_dedup_of_repeated_rows_and_null_ids(spark):
    got = corpus_pipeline.near_duplicates(spark, make(spark).filter("doc_id = 3 or doc_id is null"), "").collect()
    assert [r.doc_id for r in got] == [3]


def test_line_dedup_keeps_repeated_rows(spark):
    data = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc"), (None, "b\nc\nd"), (None, "b\nc\nd")]
    got = linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(4), removed_as="n")
    assert rows(got, "doc_id", "text", "n") == sorted(brute_lines(data, 3), key=repr)


@pytest.mark.parametrize("cell", [4000, 1 << 21])
def test_substring_of_long_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(substring, "CELL_BYTES", cell)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(20_000)]
    data = [(1, " ".join(base)), (2, " ".join(base[5000:9000] + ["cut"] + base[100:4000])), (3, " ".join(rng.choice(words) for _ in range(6000)) + " " + " ".join(base[-300:])), (3, "short text")]
    got = substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == sorted(brute_windows(data, 20), key=repr)
