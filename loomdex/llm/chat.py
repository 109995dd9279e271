"""Chat formatting: conversations as text segments with a loss flag each, by a declarative template, in column expressions only.

A ``Template`` says how a turn of each role opens and closes, whether its text is learnt, and which role may follow in
which state. Turns come in blocks of 2^``BLOCK_BITS`` turn numbers, so that a conversation of any length is spread over tasks:
``parts`` gives a row for each block, with its segments and with the automaton's function over the block (the state after
it for each state before it). ``verdicts`` composes these functions in order, which are a few bytes a block.

Control strings inside a text get a backslash after their first character, and where backslashes follow that already one
more, so a marker in the output is always the template's own and ``unescape`` gives back the text exactly.

Defined results: a null text or role is empty. A null turn comes last, rows of one turn by the MD5 of role and text; equal
rows are turns of their own. A null conv_id is a conversation of its own. A role without an entry in the template is
written by its name between the markers of ``other`` and has no transition. A conversation that breaks the order is
formatted like any other; verdicts says at which turn it breaks. An empty table gives no rows. Other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import NULL_ID, materialize

#: A block has 2^8 turn numbers.
BLOCK_BITS = 8
#: Rows from which a block is cut further: by turn, then by the hash of the row, and equal rows at will.
CROWDED = 4096
SALTS = 1024


@dataclass(frozen=True)
class Turn:
    """How a role's turns are written; learn: the loss counts their text."""

    opens: str
    closes: str
    learn: bool = False


@dataclass(frozen=True)
class Template:
    """roles: by name. other: of all further roles, whose name stands between named[0] and named[1] before the text.
    follows: from each state, which begins as "start", the state that a role leads to. accepts: where a conversation may end."""

    roles: dict[str, Turn]
    other: Turn
    named: tuple[str, str]
    follows: dict[str, dict[str, str]]
    accepts: frozenset[str]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        markers = [x for t in (*self.roles.values(), self.other) for x in (t.opens, t.closes)] + list(self.named)
        controls = {c for m in markers for c in re.findall(r"\S+", m)}
        firsts = {c[0] for c in controls}
        for m in markers:
            if len(re.findall(r"\S+", m)) != 1 or m.strip() != m.strip(" ") or "\\" in m or any(f in m.strip()[1:] for f in firsts):
                raise ValueError(f"{m!r}: a marker is one control string with spaces about it, whose first character stands nowhere else in one")
        opens = [t.opens.strip() for t in (*self.roles.values(), self.other)]
        if len(set(opens)) < len(opens):
            raise ValueError("two roles open alike")
        if self.named[0].strip() != self.other.opens.strip():
            raise ValueError("a further role's turn opens with the marker before its name")
        object.__setattr__(self, "controls", tuple(sorted(controls)))

    @property
    def states(self) -> list[str]:
        """All states, start first and the one of a broken order last."""
        found = dict.fromkeys(["start", *self.follows, *(s for to in self.follows.values() for s in to.values())])
        return [*found, "broken"]

    def _controls(self, slash: str) -> str:
        """A control string, with a backslash more or less where slash stands."""
        firsts = "".join(re.escape(f) for f in sorted({c[0] for c in self.controls}))
        rests = "|".join(re.escape(r) for r in sorted({c[1:] for c in self.controls}))
        return "([" + firsts + "])" + slash + r"(\\*(?:" + rests + "))"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._controls(""), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._controls(r"\\"), "$1$2")

    @property
    def turn_pattern(self) -> str:
        """A turn of a formatted text, from its opening to its closing marker."""
        return "(?s)" + "|".join(re.escape(t.opens) + ".*?" + re.escape(t.closes) for t in (*self.roles.values(), self.other))

    def read_turn(self, turn: Column) -> Column:
        """struct(role, text) of a turn as written."""

        def inner(t: Turn) -> Column:
            return F.substring(turn, F.lit(len(t.opens) + 1), F.length(turn) - len(t.opens) - len(t.closes))

        rest = inner(self.other)
        cut = F.instr(rest, self.named[1])
        name, text = F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + len(self.named[1]), F.length(rest))
        out = F.struct(self.unescape(name).alias("role"), self.unescape(text).alias("text"))
        for role, t in self.roles.items():
            out = F.when(turn.startswith(t.opens), F.struct(F.lit(role).alias("role"), self.unescape(inner(t)).alias("text"))).otherwise(out)
        return out

    def segments(self, role: Column, text: Column) -> Column:
        """array(struct(text, loss)) of a turn: its markers, and between them its text."""

        def piece(x: Column, loss: bool = False) -> Column:
            return F.struct(x.alias("text"), F.lit(loss).alias("loss"))

        out = F.array(piece(F.lit(self.named[0])), piece(self.escape(role)), piece(F.lit(self.named[1])), piece(self.escape(text), self.other.learn), piece(F.lit(self.other.closes)))
        for name, t in self.roles.items():
            out = F.when(role == name, F.array(piece(F.lit(t.opens)), piece(self.escape(text), t.learn), piece(F.lit(t.closes)))).otherwise(out)
        return out

    def step(self, state: Column, role: Column) -> Column:
        """The number of the state that role leads to from a state's number; the last where none is declared."""
        states, broken = self.states, len(self.states) - 1
        names = sorted({r for to in self.follows.values() for r in to})
        table = [states.index(self.follows.get(s, {}).get(r, "broken")) for r in names for s in states]
        number = F.array_position(F.array(*map(F.lit, names)), role).cast("int")
        at = (number - 1) * len(states) + state + 1
        return F.when(number == 0, F.lit(broken)).otherwise(F.element_at(F.array(*map(F.lit, table)), at))


#: Users and the system in brackets, answers between <s> and </s>; answers are learnt.
INSTRUCT = Template(
    roles={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", learn=True), "tool": Turn("[TOOL] ", " [/TOOL]")},
    other=Turn("[ROLE] ", " [/TURN]"),
    named=("[ROLE] ", " [/ROLE]"),
    follows={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked", "tool": "called"}, "called": {"assistant": "answered"}},
    accepts=frozenset({"answered"}),
)


def parts(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, block, tie, n_turns, segments (array of struct(text, loss)), effect: a row for each block of a conversation, in the
    order of block and tie. effect: by state before the block, struct(state after it, turn that broke the order or null)."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.shiftright("turn", BLOCK_BITS)).withColumn("hash", F.md5(F.concat("role", F.lit("\n"), "text")))
    crowded = rows.groupBy("conv_id", "block").count().filter(F.col("count") > CROWDED).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.lit(True).alias("_crowded"))
    cut = F.format_string("%03d/%s/%04d", F.pmod("turn", F.lit(1 << BLOCK_BITS)), "hash", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    rows = rows.withColumn("cut", cut).join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    tie = F.when(F.col("_crowded"), F.col("cut")).otherwise("")
    grouped = rows.groupBy("conv_id", "block", tie.alias("tie")).agg(F.sort_array(F.collect_list(F.struct("turn", "hash", "role", "text"))).alias("turns"))
    states = template.states
    broken = len(states) - 1

    def advance(acc: Column, t: Column) -> Column:
        def one(x: Column) -> Column:
            after = template.step(x["state"], t["role"])
            return F.struct(after.alias("state"), F.coalesce(x["broke"], F.when(after == broken, t["turn"])).alias("broke"))

        return F.transform(acc, one)

    identity = F.array(*(F.struct(F.lit(k).alias("state"), F.lit(None).cast("long").alias("broke")) for k in range(len(states))))
    return grouped.select(
        "conv_id", "block", "tie", F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["text"]))).alias("segments"),
        F.aggregate("turns", identity, advance).alias("effect"),
    )


def verdicts(parts: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, valid, broke_at (the first turn that may not stand there, or null): a row for each conversation."""
    states = template.states
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("broke"))

    def compose(acc: Column, x: Column) -> Column:
        to = F.element_at(x["effect"], acc["state"] + 1)
        return F.struct(to["state"].alias("state"), F.coalesce(acc["broke"], to["broke"]).alias("broke"))

    by = parts.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("block", "tie", "effect"))).alias("blocks"))
    end = by.select("conv_id", "n_turns", F.aggregate("blocks", start, compose).alias("end"))
    accepting = [k for k, s in enumerate(states) if s in template.accepts]
    return end.select("conv_id", "n_turns", F.col("end.state").isin(accepting).alias("valid"), F.col("end.broke").alias("broke_at"))


def read_parts(parts: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, block, tie, formatted, turns (array of struct(role, text)), learnt: what the rows of parts hold, from their segments
    alone. learnt: the texts under the loss mask, joined."""
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    out = parts.select("conv_id", "block", "tie", formatted.alias("formatted"), learnt.alias("learnt"))
    return out.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(template.turn_pattern), F.lit(0)), template.read_turn))


#: A conversation beside the table's, whose texts look like markers.
PLANTED = "SELECT -7L AS conv_id, CAST(turn AS LONG) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations as read back. A digest needs a conversation's bytes together, so this query,
    unlike parts(), holds one conversation in a row."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    written = materialize(parts(rows), "chat")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    blocks = read_parts(written).select("conv_id", F.struct("block", "tie", said.alias("said"), "learnt").alias("b"), F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("b")).alias("bs"))
    said, learnt = F.array_join(F.transform("bs", lambda b: b["said"]), ""), F.array_join(F.transform("bs", lambda b: b["learnt"]), "")
    out = whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
    v = verdicts(written).select(F.col("conv_id").alias("_c"), "valid", "broke_at")
    return out.join(v, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
