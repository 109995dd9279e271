"""The near-dedup stage against brute force, with planted near copies."""

import random

import pytest

import corpus_pipeline
from loomdex.llm import similar


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The ids that stay: the smallest of each component at a Jaccard similarity of 0.8 or more."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * union:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def planted():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    phrase = rng.choices(words, k=12)  # stands in most texts
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 200)) + phrase
        texts.append(base)
        for edits in rng.sample(range(1, 7), 3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            texts.append(copy)
    chain = rng.choices(words, k=120)
    for _ in range(40):  # each near the one before, the last far from the first
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(words)
        texts.append(chain)
    texts += [["a", "b"], ["a", "B"], ["a", "c"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("most", "rounds"), [(2048, 6), (2, 2), (10, 0)])
def test_stage_is_brute_force(spark, most, rounds):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in similar.keep_one(docs, most=most, rounds=rounds).select("doc_id").collect())
    assert got == brute(rows)


def test_stage_catches_near_copies(spark):
    base = [f"word{k}" for k in range(200)]
    near = base[:100] + ["other"] + base[101:]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(base[100:]), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_fingerprints_pair_first(spark, monkeypatch):
    """The stage goes through SimHash: near fingerprints are paired by op5's search and checked, and what they miss is found beside."""
    rng = random.Random(8)
    rows = []
    for k in range(6):
        base = [f"t{k}w{rng.randrange(10**6)}" for _ in range(3000)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:1500], "other", *base[1501:]])), (10 * k + 2, " ".join(base).upper()), (10 * k + 3, " ".join(base[:2500]))]
    rows += [(100, None), (101, " "), (102, "a b"), (103, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, links = [], similar.fingerprint_pairs

    def watched(hashed):
        ids = {r.fp: r.doc_id for r in hashed.select("fp", "doc_id").collect() if r.doc_id % 10 != 2}
        pairs.extend((ids[r.f], ids[r.g]) for r in links(hashed).collect())
        return links(hashed)

    monkeypatch.setattr(similar, "fingerprint_pairs", watched)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())
    assert got == brute(rows)
    near = {(10 * k, 10 * k + 1) for k in range(6) if (similar.majority(similar.hashes(rows[4 * k][1].encode(), 5)) ^ similar.majority(similar.hashes(rows[4 * k + 1][1].encode(), 5))).bit_count() <= 2}
    assert near and near <= {tuple(sorted(p)) for p in pairs}
