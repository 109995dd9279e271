"""Substring dedup against brute force: passages in every document, heavy prefixes, other lengths, hashes that collide."""

import random

import numpy as np
import pytest

from loomdex.llm import substring

from .test_operators import brute_windows, rows


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    license_ = [f"l{k}" for k in range(45)]
    phrase = "one of the most important things".split()
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        t[len(t) // 2 : len(t) // 2] = license_ if i % 3 else license_[:30] + ["other"] + license_[30:]
        for _ in range(3):
            at = rng.randrange(len(t) + 1)
            t[at:at] = phrase
        out.append((i, " ".join(t)))
    copied = [(1000 + k, out[k][1] + " tail " + out[k + 1][1]) for k in range(5)]
    odd = [(None, out[4][1]), (7, out[7][1]), (7, "x " + out[9][1]), (2000, "a b " * 60), (2001, "same " * 70), (2002, None), (2003, ""), (2004, "one two"), (-5, out[11][1])]
    return out + copied + odd


@pytest.mark.parametrize(("heavy", "group", "length"), [(None, 150_000, 20), (2, 100, 20), (30, 50, 20), (4, 40, 12), (3, 60, 33)])
def test_windows_are_brute_force(spark, monkeypatch, heavy, group, length):
    monkeypatch.setattr(substring, "CELL_BYTES", 3000)
    data = corpus()
    df = spark.createDataFrame([(*r, 1, "g") for r in data], "doc_id long, text string, cell long, grp string").repartition(4)
    got = substring.remove_repeats(df, length=length, heavy=heavy, group_size=group)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == sorted(brute_windows(data, length), key=repr)


def test_a_collision_is_resolved_by_the_words(monkeypatch):
    monkeypatch.setattr(substring, "rolling", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    c = substring.Cell([b" ".join(b"w%d" % k for k in range(30)), b" ".join(b"w%d" % k for k in range(5, 30))])
    starts = c.windows
    doc = c.doc[starts]
    first = c.leaders(starts, doc, starts - c.start[doc])
    assert [c.window(s) for s in starts[first]] == [c.window(s) for s in starts] and len(set(first.tolist())) == 11


def test_nodes_of_a_tree():
    words = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 5], [1, 2, 3]], np.int32)
    order, common = substring.branches(words)
    assert common.tolist() == [3, 2, 1]
    node = substring.node_of(order, common, 2)
    assert node[0] == node[1] == node[3] != node[2]


def test_wrong_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="words"):
        substring.remove_repeats(df, length=5)
