"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from loomdex.llm import langid, simhash


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    base = [f"line {k} of words that nothing else holds number {k * 7}" for k in range(40)]
    rows = [(i, "\n".join(base[i : i + 6]), "en", f"s{i % 3}", 1) for i in range(0, 30, 6)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, "12 34", "en", "s0", 1), (102, None, None, None, None), (103, "", "en", "s1", 0), (1, "a few words", "en", "s1", 3), (1, "a few words", "en", "s1", 3)]
    docs = make(spark, rows)
    names = docs.columns
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {0, 6, 12, 18, 24, 100, 1}
    lined = corpus_pipeline.lines(spark, kept, "")
    assert lined.columns == names and 100 not in {r.doc_id for r in lined.collect()} and lined.count() == 7
    one = corpus_pipeline.near_duplicates(spark, kept, "")
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == [0, 1, 6, 12, 18, 24]
    mixed = corpus_pipeline.mixture(spark, one, "")
    assert mixed.columns == names
    out = corpus_pipeline.tokens(spark, mixed, "")
    assert out.count() == mixed.count()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert groups[100] == 0


def test_empty_documents(spark):
    docs = make(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "source mixing", "BPE"]
    assert langid.UND == "und"
