"""The word tokenizer against the library, on random texts with special tokens, and files of a shared doc_id."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomdex.llm import tokenfile

PATH = public_tokenizers.path(tokenfile.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "Word", "été", "É", "e\u0301", "don't", "3", " ", "\n", "\u00a0", "\u2003", "!?", "İ", "ς", "Σ", "設計"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS | st.text(max_size=8), max_size=12))
def test_words_are_the_library(parts):
    text = "".join(parts)
    got = tokenfile.tokenizer(PATH).encode([text.encode("utf-8", "ignore")])[0]
    assert list(memoryview(got).cast("I")) == LIBRARY.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def test_special_token_has_its_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|startoftext|>")], "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "t"))
    ids = {r.doc_id: list(r.ids) for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert 49407 in ids[1] and ids[2] == [49406, 1]


def test_a_shared_id_is_split(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"word {k}") for k in range(400)] + [(k, "x") for k in range(4)], "doc_id long, text string").repartition(4)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs, path, shard_rows=50)
    got = tokenfile.with_starts(tokenfile.summaries(spark, path), path).orderBy("start").collect()
    assert len(got) == 404 and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(404)]
    assert [r.doc_id for r in got] == [0, 1, 2, 3] + [5] * 400 and len({r.shard for r in got}) > 4
