"""Chat archives: roles, tails, exports, transcripts and exported trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions.work import written

#: The words for each role; others are the user's.
ROLES = {
    "user": ("user", "human", "you", "me", "prompt"),
    "assistant": ("assistant", "bot", "model", "gpt", "ai", "claude", "chatgpt", "gemini"),
    "system": ("system",),
    "tool": ("tool", "function", "tool_result", "tool_use"),
}


def role(word: Column, default: str = "user") -> Column:
    w, out = F.lower(F.trim(word)), F.lit(default)
    for name, words in ROLES.items():
        out = F.when(w.isin(*words), name).otherwise(out)
    return out


def numbered(messages: DataFrame) -> DataFrame:
    """conv_id, seq (from 1, by turn), role, text, tokens."""
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.select("conv_id", seq.cast("long").alias("seq"), role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), X.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def tail(messages: DataFrame, tokens: int | None = None, turns: int | None = None) -> DataFrame:
    """The last messages of each conversation that fit the budget, ended by the first that doesn't; the last is always kept."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    rows = messages.withColumn("_n", F.row_number().over(back)).withColumn("_t", F.sum("tokens").over(back))
    keep = F.lit(True)
    if turns is not None:
        keep &= F.col("_n") <= turns
    if tokens is not None:
        keep &= F.col("_t") <= tokens
    return rows.filter(keep | (F.col("_n") == 1)).drop("_n", "_t")


def participants(messages: DataFrame) -> DataFrame:
    """conv_id, roles, (models,) messages, tokens of each conversation."""
    if "model" in messages.columns:
        pairs = messages.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("role", "model"))).alias("models"))
        return participants(messages.drop("model")).join(pairs, "conv_id")
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def merged_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: neighbouring messages of one role as one turn."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    start = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    rows = messages.withColumn("_s", start).withColumn("turn", F.sum("_s").over(w))
    parts = rows.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("m"))
    return parts.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("text"))


def export(messages: DataFrame, style: str = "openai") -> DataFrame:
    """conv_id, payload: a conversation as JSON messages (openai: all; anthropic: system apart), a JSON line for each
    message (jsonl), or as Markdown."""
    held = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("m"))
    if style == "markdown":
        block = lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), x["text"])
        return held.select("conv_id", F.array_join(F.transform("m", block), "\n\n").alias("payload"))
    item = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    if style == "openai":
        return held.select("conv_id", F.to_json(F.struct(F.transform("m", item).alias("messages"))).alias("payload"))
    if style == "anthropic":
        rest = F.transform(F.filter("m", lambda x: x["role"] != "system"), item)
        system = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["text"]), "\n\n")
        return held.select("conv_id", F.to_json(F.struct(system.alias("system"), rest.alias("messages"))).alias("payload"))
    if style == "jsonl":
        line = lambda x: F.to_json(F.struct(x["role"].alias("role"), x["seq"].alias("seq"), x["text"].alias("text")))
        return held.select("conv_id", F.array_join(F.transform("m", line), "\n").alias("payload"))
    raise ValueError(f"unknown style {style}")


def branch(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, node, kind: the path from each conversation's head to its root, and the messages off it as abandoned.

    nodes: conv_id, node, parent; heads: conv_id, node. Ancestors double each round, so a path of n nodes takes log2(n)
    rounds, whatever n; each round is written, and one count tells whether it reached anything new.
    """
    up = written(nodes.select("conv_id", "node", F.col("parent").alias("far")).filter("far is not null"), "branch-up")
    met = written(heads.select("conv_id", "node").distinct(), "branch-met")
    n, before = met.count(), -1
    while n != before:
        new = met.join(up, ["conv_id", "node"]).select("conv_id", F.col("far").alias("node"))
        met = written(met.unionByName(new).distinct(), "branch-met")
        hop = up.select("conv_id", F.col("node").alias("far"), F.col("far").alias("farther"))
        up = written(up.join(hop, ["conv_id", "far"]).select("conv_id", "node", F.col("farther").alias("far")), "branch-up")
        n, before = met.count(), n
    on = met.join(nodes, ["conv_id", "node"], "left_semi").withColumn("_on", F.lit(True))
    return nodes.join(on, ["conv_id", "node"], "left").select("conv_id", "node", F.when(F.col("_on"), "message").otherwise("abandoned_branch").alias("kind"))


#: Words that begin a turn of a pasted chat, before a colon, perhaps with "said" between.
LABELS = ("you", "user", "me", "human", "chatgpt", "claude", "gemini", "assistant", "copilot", "bot", "ai")
#: The conventions by which a transcript marks its turns, the first of equals counting.
CONVENTIONS = ("callout", "heading", "bold")


def known_role(word: Column) -> Column:
    return F.lower(word).isin(*[w for ws in ROLES.values() for w in ws])


def marker(line: Column) -> Column:
    """struct of convention, label, rest of a line that marks a turn, else null: a callout in a quote, > [!user]; a heading
    whose text begins with a role, perhaps after a number, ## 3. User; or a role before a colon, perhaps in bold, **User:**."""
    quote = F.ltrim(F.ltrim(line, F.lit(">")))
    callout = F.regexp_extract(quote, r"^\[!(\w+)\]", 1)
    title = F.regexp_replace(F.ltrim(line, F.lit("#")), "^ +([0-9]+ *[.·-])? *", "")
    heading = F.regexp_extract(title, r"^(\w+)", 1)
    head = F.split_part(line, F.lit(":"), F.lit(1))
    bold = F.trim(F.trim(head, F.lit("* ")))
    after = lambda text, n: F.substring(text, n, F.length(text))
    found = lambda name, word, rest: F.struct(F.lit(name).alias("convention"), word.alias("label"), rest.alias("rest"))
    is_heading = line.startswith("#") & (F.length(line) - F.length(F.ltrim(line, F.lit("#"))) <= 6) & F.ltrim(line, F.lit("#")).startswith(" ")
    is_bold = (F.length(head) < F.length(line)) & ~line.startswith(" ") & (F.length(head) - F.length(F.ltrim(head, F.lit("*"))) <= 2)
    return (
        F.when(line.startswith(">") & quote.startswith("[!") & known_role(callout), found("callout", callout, F.trim(after(quote, F.length(callout) + 4))))
        .when(is_heading & known_role(heading), found("heading", heading, F.trim(after(title, F.length(heading) + 1))))
        .when(is_bold & known_role(bold), found("bold", bold, F.ltrim(after(line, F.length(head) + 2), F.lit("* "))))
    )


def marked(lines: DataFrame) -> DataFrame:
    """lines (doc, n, line) with convention, label, rest of those that mark a turn."""
    return lines.withColumn("_m", marker(F.col("line"))).select(*lines.columns, "_m.convention", "_m.label", "_m.rest")


def convention(lines: DataFrame) -> DataFrame:
    """doc, convention, markers: of each document the convention with the most markers."""
    counts = marked(lines).filter("convention is not null").groupBy("doc", "convention").agg(F.count("*").alias("markers"))
    order = F.array_position(F.array(*map(F.lit, CONVENTIONS)), F.col("convention"))
    best = counts.groupBy("doc").agg(F.max_by(F.struct("convention", "markers"), F.struct("markers", -order)).alias("b"))
    return best.select("doc", "b.convention", "b.markers")


def marked_turns(lines: DataFrame) -> DataFrame:
    """doc, seq, role, model, text of transcripts by their own convention; what stands before the first marker is a fragment.
    A callout's turn ends with its quote. lines: doc, n, line."""
    rows = marked(lines).join(convention(lines).select("doc", F.col("convention").alias("_c")), "doc", "left")
    starts = F.coalesce(F.col("convention") == F.col("_c"), F.lit(False))
    w = Window.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("_start", starts).withColumn("turn", F.sum(F.col("_start").cast("int")).over(w))
    quote = F.col("line").rlike(r"^\s*>")
    rows = rows.withColumn("_ended", F.max((~quote & ~F.col("_start")).cast("int")).over(Window.partitionBy("doc", "turn").orderBy("n")))
    rows = rows.filter((F.col("_c") != "callout") | F.col("_c").isNull() | (F.col("turn") == 0) | (F.col("_ended") == 0))
    body = F.when(F.col("_start"), F.when(F.col("_c") == "bold", F.col("rest")).otherwise("")).when(F.col("_c") == "callout", F.regexp_replace("line", r"^\s*> ?", "")).otherwise(F.col("line"))
    model = F.when(F.col("_start") & (F.col("_c") != "bold"), F.trim(F.col("rest"), F.lit(" ()[]·:-")))  # what stands in brackets or after a dash
    by = rows.groupBy("doc", "turn").agg(F.first(F.when(F.col("_start"), F.col("label")), True).alias("label"), F.first(model, True).alias("model"), F.array_sort(F.collect_list(F.struct("n", body.alias("b")))).alias("l"))
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["b"]), "\n"), r"^\n+|\n+$", "")
    out = by.select("doc", "turn", F.when(F.col("turn") == 0, "fragment").otherwise(role(F.coalesce("label", F.lit("")))).alias("role"), F.when(F.col("model") != "", F.col("model")).alias("model"), text.alias("text")).filter("turn > 0 or trim(text) <> ''")
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("turn")).cast("long")).select("doc", "seq", "role", "model", "text")


def pasted(lines: DataFrame) -> DataFrame:
    """doc, seq, role, text, reason of pasted chats: turns begin at labels; with fewer than two the whole is one fragment,
    as roles aren't guessed. lines: doc, n, line."""
    head = F.split_part("line", F.lit(":"), F.lit(1))
    who = F.regexp_replace(F.lower(F.trim(head)), " +said$", "")
    hit = who.isin(*LABELS) & (F.length(head) < F.length("line"))
    said = F.ltrim(F.substring(F.col("line"), F.length(head) + 2, F.length("line")))
    w = Window.partitionBy("doc")
    rows = lines.withColumn("_hit", hit).withColumn("labels", F.sum(F.col("_hit").cast("int")).over(w))
    rows = rows.withColumn("turn", F.when(F.col("labels") < 2, 0).otherwise(F.sum(F.col("_hit").cast("int")).over(w.orderBy("n"))))
    starts = F.col("_hit") & (F.col("labels") >= 2)
    by = rows.groupBy("doc", "turn").agg(
        F.first(F.when(starts, who), True).alias("label"), F.max("labels").alias("labels"),
        F.array_sort(F.collect_list(F.struct("n", F.when(starts, said).otherwise(F.col("line")).alias("b")))).alias("l"),
    )
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["b"]), "\n"), r"^\n+|\n+$", "")
    reason = F.when(F.col("labels") < 2, "unsegmented_paste").when(F.col("turn") == 0, "preamble")
    out = by.select("doc", "turn", F.when(reason.isNotNull(), "fragment").otherwise(role(F.coalesce("label", F.lit("")))).alias("role"), text.alias("text"), reason.alias("reason")).filter("turn > 0 or reason = 'unsegmented_paste' or trim(text) <> ''")
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("turn")).cast("long")).select("doc", "seq", "role", "text", "reason")


def reader(texts: DataFrame, column: str = "text", mapped: bool = False) -> DataFrame:
    """texts with reader: which one reads each, in fixed order: ChatGPT's tree export, Claude's export, mapped JSON (only with
    a mapping), a transcript with two markers or more, and any other text that isn't JSON as a paste; else null."""
    t = F.col(column)
    is_json = F.try_parse_json(t).isNotNull()
    markers = F.size(F.filter(F.split(t, "\n"), lambda line: marker(line).isNotNull()))
    kind = F.when(is_json & t.contains('"mapping"') & t.contains('"current_node"'), "chatgpt").when(is_json & t.contains('"chat_messages"'), "claude")
    kind = kind.when(is_json & F.lit(mapped), "generic").when(~is_json & (markers >= 2), "transcript").when(~is_json & (F.trim(t) != ""), "pasted")
    return texts.withColumn("reader", kind)


# The archive


def archived(archive: DataFrame, new: DataFrame) -> DataFrame:
    """archive (conv_id, source_digest, started_at, imported_at, ...) with new conversations; a source that is there already
    adds nothing, so an import may be repeated."""
    fresh = new.dropDuplicates(["source_digest"]).join(archive.select("source_digest"), "source_digest", "left_anti")
    return archive.unionByName(fresh.select(*archive.columns))


def listed(archive: DataFrame, project: str | None = None) -> DataFrame:
    """The archive with place: newest first, by when a conversation started or else was imported, then by id."""
    rows = archive if project is None else archive.filter(F.col("project") == project)
    when = F.coalesce("started_at", "imported_at")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(when.desc(), F.desc("conv_id"))))  # a list for a reader


def find(archive: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, conv_id, error: the one conversation whose id is, begins or ends with what was asked for; none, or more than one, is
    an error."""
    a = asked.select("asked").distinct().withColumn("_a", F.upper(F.trim("asked"))).filter("_a <> ''")
    ids = archive.select("conv_id").distinct()
    whole, parts = ids.withColumn("_a", F.col("conv_id")), None
    sizes = F.broadcast(a.agg(F.collect_set(F.length("_a")).alias("sizes")))  # one row
    cut = ids.crossJoin(sizes).select("conv_id", F.explode("sizes").alias("n"))
    for end in (F.substring(F.col("conv_id"), F.lit(1), F.col("n")), F.expr("right(conv_id, n)")):
        one = cut.select("conv_id", end.alias("_a"))
        parts = one if parts is None else parts.unionByName(one)
    met = a.join(whole.select("conv_id", "_a").unionByName(parts).distinct(), "_a", "left").groupBy("asked").agg(F.min("conv_id").alias("conv_id"), F.countDistinct("conv_id").alias("n"))
    error = F.when(F.col("n") == 0, "no such conversation").when(F.col("n") > 1, "more than one conversation")
    return met.select("asked", F.when(F.col("n") == 1, F.col("conv_id")).alias("conv_id"), error.alias("error"))


def purged(tables: dict[str, DataFrame], conv_ids: DataFrame, custody: bool = False) -> dict[str, DataFrame]:
    """The archive's tables without the conversations; with custody also without the bytes they came from."""
    doomed = conv_ids.select("conv_id").distinct()
    out = {name: t.join(doomed, "conv_id", "left_anti") if "conv_id" in t.columns else t for name, t in tables.items()}
    if custody:
        gone = tables["archive"].join(doomed, "conv_id", "left_semi").select(F.col("source_digest").alias("digest"))
        out["custody"] = tables["custody"].join(gone, "digest", "left_anti")
    return out


def projected(messages: DataFrame) -> DataFrame:
    """conv_id, text: a conversation as Markdown: a heading for each message, its text with lines that would open a heading
    escaped. messages: conv_id, seq, role, text."""
    calm = F.regexp_replace("text", r"(?m)^(?=#{1,6}(?:\s|$)|(?:=+|-+)[ \t]*$)", r"\\")
    block = F.concat(F.lit("## "), F.col("seq").cast("string"), F.lit(" · "), "role", F.lit("\n\n"), calm)
    by = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("l"))
    return by.select("conv_id", F.concat(F.array_join(F.transform("l", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("text"))


def checked_boundaries(proposals: DataFrame) -> DataFrame:
    """doc, problem: the first thing wrong with a proposed segmentation, or null: it begins at line 0, its lines rise, lie in
    the text, and have known roles. proposals: doc, turns (array of line, role), lines (how many there are)."""
    turns, known = F.col("turns"), list(ROLES)
    at = lambda k: F.get(turns, k)
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(turns) - 1, F.lit(1))), lambda k: F.coalesce(at(k)["line"] <= at(k - 1)["line"], F.lit(False)))
    problem = (
        F.when(turns.isNull() | (F.size(turns) == 0), "no turns").when(F.exists(turns, lambda t: t["line"].isNull()), "a turn without a line").when(at(F.lit(0))["line"] != 0, "lines before the first turn")
        .when(falls, "lines do not rise").when(F.exists(turns, lambda t: t["line"] >= F.col("lines")), "a line beyond the text").when(F.exists(turns, lambda t: t["role"].isNull() | ~t["role"].isin(*known)), "an unknown role")
    )
    return proposals.select("doc", problem.alias("problem"))


def segmented(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """doc, seq, role, text: texts cut at sound proposals; the text is the lines' own, whoever proposed the cuts. lines: doc,
    n (from 0), line."""
    sound = proposals.join(checked_boundaries(proposals).filter("problem is null").select("doc"), "doc", "left_semi")
    cuts = sound.select("doc", F.posexplode("turns").alias("k", "t")).select("doc", F.col("t.line").alias("n"), (F.col("k") + 1).alias("_seq"), "t.role")
    rows = lines.join(sound.select("doc"), "doc", "left_semi").join(cuts, ["doc", "n"], "left").withColumn("seq", F.max("_seq").over(Window.partitionBy("doc").orderBy("n")))
    by = rows.groupBy("doc", "seq").agg(F.first("role", True).alias("role"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")
    return by.select("doc", F.col("seq").cast("long").alias("seq"), "role", text.alias("text"))


def fidelity(messages: DataFrame) -> DataFrame:
    """conv_id, messages, fragments, empty, loss: how much of each conversation came through as messages."""
    by = messages.groupBy("conv_id").agg(F.count_if(F.col("role") != "fragment").alias("messages"), F.count_if(F.col("role") == "fragment").alias("fragments"), F.count_if(F.trim("text") == "").alias("empty"))
    return by.withColumn("loss", F.round((F.col("fragments") + F.col("empty")) / (F.col("messages") + F.col("fragments")), 6))


def transcript(lines: DataFrame) -> DataFrame:
    """doc, turn, role, text from lines (doc, n, line): a line ``Label:`` with a known role's word begins a turn; with
    fewer than two labels the whole is one fragment."""
    words = [w for ws in ROLES.values() for w in ws]
    label = F.regexp_extract("line", r"^\s*(?:#+\s*|\*\*)?([A-Za-z_]+)(?:\*\*)?\s*:", 1)
    known = F.lower(label).isin(*words)
    w = Window.partitionBy("doc").orderBy("n")
    rows = lines.withColumn("label", F.when(known, label)).withColumn("turn", F.count("label").over(w)).withColumn("labels", F.count("label").over(Window.partitionBy("doc")))
    rows = rows.withColumn("turn", F.when(F.col("labels") < 2, 0).otherwise(F.col("turn"))).withColumn("body", F.when((F.col("labels") >= 2) & known, F.regexp_replace("line", r"^[^:]*:\s?", "")).otherwise(F.col("line")))
    turns = rows.groupBy("doc", "turn").agg(F.first("label", True).alias("label"), F.max("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("b"))
    text = F.trim(F.array_join(F.transform("b", lambda x: x["body"]), "\n"))
    return turns.select("doc", F.col("turn").cast("long").alias("turn"), F.when(F.col("labels") >= 2, role(F.coalesce("label", F.lit("")))).otherwise("fragment").alias("role"), text.alias("text")).filter("text <> ''")
