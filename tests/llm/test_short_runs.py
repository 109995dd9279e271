"""Line dedup of single lines and pairs that carry enough words, against brute force."""

import random

import corpus_pipeline
from loomdex.llm import linededup


def brute(docs, n, words):
    first, runs = {}, []
    for i, t in docs:
        ls = t.split("\n") if t else []
        for size in range(1, n + 1):
            for p in range(len(ls) - size + 1):
                run = ls[p : p + size]
                if size == n or (all(x.split() for x in run) and sum(len(x.split()) for x in run) >= words):
                    runs.append((i, p, tuple(run)))
                    first[tuple(run)] = min(first.get(tuple(run), (i, p)), (i, p))
    gone = {(i, p + k) for i, p, run in runs if first[run] < (i, p) for k in range(len(run))}
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in docs)


def test_short_runs_random(spark):
    rng = random.Random(2)
    lines = ["", " ", "a", "b c", "d e f", "g h i j", *(" ".join(f"w{rng.randrange(99)}" for _ in range(k)) for k in range(1, 9) for _ in range(6))]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for n, g in ((3, 2), (4, 1), (2, 2)):
        got = linededup.dedup_lines(df, min_run=n, gram=g, words=6)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == brute(docs, n, 6)


def test_stage_deletes_a_repeated_line_and_pair(spark):
    line, pair = "one line of more than five words", "three short words\nand three more"
    rows = [(1, f"first\n{line}\nend"), (2, f"second\n{line}\nlast"), (3, line), (4, f"x\n{pair}\ny"), (5, f"z\n{pair}")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "second\nlast", 4: rows[3][1], 5: "z"}
