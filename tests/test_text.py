import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import text as X


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("triplicate", "triplic"), ("electrical", "electr"), ("hopefulness", "hope"), ("allowance", "allow"), ("replacement", "replac"), ("adoption", "adopt"), ("communism", "commun"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")])
def test_porter_published_examples(word, stem):
    assert X.porter(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_normalize_is_idempotent(t):
    once = X.normalize_text(t)
    assert X.normalize_text(once) == once and "\r" not in once and unicodedata.is_normalized("NFC", once)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_slug_is_its_own_slug(t):
    s = X.heading_slug(t)
    assert s and not s.startswith("-") and X.heading_slug(s) == s


def test_canonical_json():
    assert X.canonical_json({"b": 2.0, "a": [1.5, None, "e\u0301"]}) == '{"a":[1.5,null,"e\u0301"],"b":2}'  # text stays as it is
    with pytest.raises(ValueError):
        X.canonical_json(math.nan)


def test_columns(spark):
    rows = [("Café naïve foo_bar uv.lock 設計書 C++ x²y ΑΒΓ ß ½",), ("cafés",), ("the of",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(X.index_tokens(F.col("t")), X.query_terms(F.col("t")), X.token_estimate(F.col("t"))).collect()
    assert sorted(got[0][0]) == sorted("bar c cafe foo lock naive uv x²y ½ ß αβγ 設計書".split())
    assert got[1][0] == ["cafes"] and got[2][1] == ["the", "of"] and got[3][0] == [] and got[3][2] == 0
    assert "foo_bar" in got[0][1]


def test_globs_and_paths(spark):
    df = spark.createDataFrame([("a/b/c.md",), ("drafts/x.md",), ("a/../d/./e.md",)], "p string")
    hit = lambda g: [r[0] for r in df.select(X.excluded(F.col("p"), [g])).collect()]
    assert hit("drafts") == [False, True, False] and hit("a/*/c.md") == [True, False, False] and hit("**/c.md") == [True, False, False] and hit("c.md") == [True, False, False] and hit("a/*") == [True, False, True]
    assert [r[0] for r in df.select(X.folded_path(F.col("p"))).collect()][2] == "d/e.md"


def test_percentile_rounds_half_to_even(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],)], "v array<double>")
    assert [tuple(r) for r in df.select(X.percentile(F.col("v"), 0.5), X.percentile(F.col("v"), 0.95, floor=True)).collect()] == [(3.0, 3.0), (None, None)]
