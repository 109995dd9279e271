"""op12 against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from loomdex.llm import spelling

SCHEMA = "doc_id long, text string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    form, nears = {}, {}
    for w in n:
        nears[w] = [v for v in n if near(w, v)]
        if nears[w]:
            best = min(nears[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(nears[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def rows_of(rng, words, docs):
    return [(d, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=400))) for d in range(docs)]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abnéß", k=rng.randint(5, 9))) for _ in range(40)]
    words = base + [w[:k] + c + w[k + j :] for w in base for k, c, j in [(rng.randrange(len(w)), rng.choice("abnÉ×÷"), rng.choice([0, 1]))] * 2] + [w.upper() for w in base] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "naaaaa", "aaaaan"]
    rows = rows_of(rng, words, 60) + [(None, "aaaaaa bbbbbb " * 3), (3, None), (3, ""), (7, "İstanbul aaaaaan_aaaaaa9naaaaa " * 6)]
    got = spelling.variants(spelling.words(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", word string"))).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.count() == got.select("word").distinct().count()


def test_chain_of_forms(spark):
    table = spark.createDataFrame([("abcdef" + "x" * k, 5**k) for k in range(9)] + [("zzzzzz", 9)], "word string, n long")
    got = {r.word: r for r in spelling.variants(table).collect()}
    assert all(got["abcdef" + "x" * k].root == "abcdef" + "x" * 8 for k in range(9)) and got["abcdef"].form == "abcdefx"
    assert got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].form is None and got["zzzzzz"].n_near == 0


def test_very_long_words(spark):
    long = "ab" * 100_000
    table = spark.createDataFrame([(long, 50), (long[:70_000] + long[70_001:], 5), (long[:-1] + "z", 6), (long + "yz", 7)], "word string, n long")
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(table).collect()}
    assert got[long] == (None, 2) and got[long + "yz"] == (None, 0)
    assert got[long[:-1] + "z"] == (long, 1) and got[long[:70_000] + long[70_001:]] == (long, 1)


def test_keys_of_all_near_words_meet():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choices("ab", k=rng.randint(1, 9)))
        k = rng.randrange(len(w))
        keys = [spelling.keys_of(np.array([ord(c) for c in x], np.uint32)) for x in (w, w[:k] + "c" + w[k + 1 :], w[:k] + w[k + 1 :] if len(w) > 1 else w)]
        assert len(set(keys[0].tolist())) == len(keys[0]) == 1 + len({w[:j] + w[j + 1 :] for j in range(len(w))})
        assert set(keys[0].tolist()) & set(keys[1].tolist())
        if len(w) > 1:
            assert keys[2][0] in keys[0][1:]


def test_one_apart():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_apart(a, b) == near(a, b)


def test_empty_table(spark):
    assert spelling.variants(spelling.words(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_table_of_words_goes_through_the_driver(spark):
    table = spark.createDataFrame([("walking", 50), ("walkin", 5), ("talking", 6)], "word string, n long")
    for found in (spelling.near_pairs(table), spelling.variants(table)):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().toString()
