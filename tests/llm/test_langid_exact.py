"""Posteriors against a brute-force naive Bayes in plain Python, ties, and held-out accuracy on the synthetic table."""

import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdex.llm import langid

MASK = 0xFFFFFFFF


def grams(text, bits):
    """The hashed 1-, 2- and 3-grams of a text, character by character."""
    c = [ord(x) for x in f" {text.lower()} "]
    for n in (1, 2, 3):
        for at in range(len(c) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ c[at + k]) * 0x9E3779B1 + k + 1) & MASK
            yield (((h ^ (h >> 15)) * 0x85EBCA6B) & MASK) >> (32 - bits)


def brute(train, texts, shape):
    counts, docs = {}, Counter()
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text, shape.bits))
        docs[lang] += 1
    out = []
    for t in texts:
        logs = {}
        for lang, seen in counts.items():
            low = math.log(sum(seen.values()) + shape.alpha * 2**shape.bits)
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log(seen[g] + shape.alpha) - low for g in grams(t, shape.bits))
        top = max(logs.values())
        out.append((min(x for x in logs if logs[x] == top), 1 / sum(math.exp(x - top) for x in logs.values())))
    return out


@pytest.mark.parametrize("lot", [1, 300, 1 << 20])
def test_posteriors(spark, lot):
    rng = random.Random(4)
    shape = langid.Shape(bits=10, piece=50)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(n))
    rows = [(i, make({"aa": "abcé", "bb": "bcdÉ", "cc": "cdea"}[lang], rng.randrange(1, 30)), lang) for i in range(90) for lang in [rng.choice(["aa", "bb", "cc"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = [t for _, t, _ in rows] + ["ab", "é", "z" * 200]
    langs, scores = langid.score(texts, langid.train(df, shape), lot)
    for got_lang, got, (lang, p) in zip(langs, scores, brute(train, texts, shape), strict=True):
        assert got_lang == lang and abs(got - p) < 1e-9


def test_ties_go_to_the_first_language(spark):
    rows = [(k, "abc", lang) for k in range(40) for lang in ("zz", "aa")]
    langs, scores = langid.score(["abc", "cab"], langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert langs == ["aa", "aa"] and all(abs(p - 0.5) < 1e-12 for p in scores)


def test_too_many_languages_raise(spark):
    rows = [(k, "abc", f"l{k}") for k in range(20)]
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the synthetic tables are absent")
def test_held_out_accuracy(spark):
    got = langid.op6_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    n, right = got.join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right >= 0.95 * n
