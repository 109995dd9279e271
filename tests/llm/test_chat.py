"""op11: round trips, the automaton and odd rows, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] \\", "<", "[", "<\\", " [/INST]", "</s", "[ROLE] x [/ROLE] ", "", "<s><s>", "$1\\$2", "a\nb\r c", "😀[INST]\U0001f600", "[[INST]]<</s>>"]


def test_texts_come_back(spark):
    rng = random.Random(7)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", " ", "TURN]", "/ROLE]", "x", "é"]
    texts = NASTY + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(600)]
    roles = ["user", "assistant", "system", "tool", "", "[INST]", "a [/ROLE] b", "</s>"]
    rows = [(k // 50, k % 50, roles[k % len(roles)], t) for k, t in enumerate(texts)]
    parts = chat.parts(spark.createDataFrame(rows, SCHEMA))
    read = chat.read_parts(parts).orderBy("conv_id", "block", "tie").collect()
    assert [(t.role, t.text) for r in read for t in r.turns] == [(r[2], r[3]) for r in rows]
    learnt = {}
    for c, _, role, text in rows:
        learnt[c] = learnt.get(c, "") + (text if role == "assistant" else "")
    assert {r.conv_id: r.learnt for r in read} == learnt
    for r in read:  # nothing in a text looks like a marker: there are as many as turns open
        assert r.formatted.count("[INST]") == sum(t.role == "user" for t in r.turns)
        assert r.formatted.count("</s>") == sum(t.role == "assistant" for t in r.turns)


def walk(roles, template=chat.INSTRUCT):
    state = "start"
    for k, r in enumerate(roles):
        state = template.follows.get(state, {}).get(r)
        if state is None:
            return False, k
    return state in template.accepts, None


def test_automaton_over_blocks(spark):
    """Conversations longer than a block, broken at any place."""
    rng, rows, want = random.Random(3), [], {}
    for c in range(30):
        roles = ["system"] * (c % 2) + ["user", "assistant"] * rng.choice([1, 3, 200, 400])
        if c % 3 == 0:
            roles[rng.randrange(len(roles))] = rng.choice(["user", "robot", "system", None])
        want[c] = walk([r or "" for r in roles])
        rows += [(c, k, r, f"t{k}") for k, r in enumerate(roles)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.valid, r.broke_at) for r in chat.verdicts(chat.parts(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == want
    assert chat.parts(spark.createDataFrame(rows, SCHEMA)).agg(F.max("n_turns")).first()[0] <= 1 << chat.BLOCK_BITS


def said(rows):
    return "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)


def test_odd_rows(spark, monkeypatch):
    """Nulls, ties, repeated rows and a block of too many rows give the same in whatever pieces."""
    rows = [(None, None, None, None), (None, 0, "user", "a"), (1, None, "assistant", "last"), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "assistant", "b"), (1, -300, "system", "first"), (2, 5, "user", "long " * 100000)]
    rows += [(3, 0, "user", "same")] * 40 + [(3, 0, "user", f"u{k}") for k in range(40)] + [(3, 1, "assistant", "end")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", block string, hash string").repartition(5)

    def texts():
        found = {}
        for r in chat.read_parts(chat.parts(df)).orderBy("conv_id", "block", "tie").collect():
            found.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        return found

    def order(r):
        return (r[1] is None, r[1], hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest())

    want = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)] for c in {r[0] for r in rows}}
    assert texts() == want
    monkeypatch.setattr(chat, "CROWDED", 8)
    assert texts() == want
    assert chat.parts(df).filter("conv_id = 3").count() > 40
    assert chat.parts(df.limit(0)).count() == 0 and chat.verdicts(chat.parts(df.limit(0))).count() == 0


def test_other_template(spark):
    marks = chat.Template(
        roles={"user": chat.Turn("<|user|> ", " <|end_user|>"), "assistant": chat.Turn("<|bot|> ", " <|end_bot|>", learn=True)}, other=chat.Turn("<|role|> ", " <|end|>"), named=("<|role|> ", " <|is|>"),
        follows={"start": {"user": "u"}, "u": {"assistant": "a"}, "a": {"user": "u"}}, accepts=frozenset("a"),
    )
    df = spark.createDataFrame([(1, 0, "user", "<|bot|> <\\|end|>"), (1, 1, "assistant", "<|end_bot|>"), (1, 2, "judge", "<|is|>")], SCHEMA)
    row = chat.read_parts(chat.parts(df, marks), marks).first()
    assert [tuple(t) for t in row.turns] == [("user", "<|bot|> <\\|end|>"), ("assistant", "<|end_bot|>"), ("judge", "<|is|>")] and row.learnt == "<|end_bot|>"
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Turn("[A] [B] ", " [/A]")}, other=chat.Turn("[O] ", " [/O]"), named=("[O] ", " [N]"), follows={}, accepts=frozenset())


def test_no_python_in_the_plan(spark, capsys):
    chat.verdicts(chat.parts(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
