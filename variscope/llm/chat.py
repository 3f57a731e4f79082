"""Conversations by quotation linking.

Lines are parsed into quote levels ('>' marks, nested by their number). The lines of a quoted run at one level make a
passage, however the mail program wrapped them; its words, normalised, are cut into windows of ``WINDOW_WORDS`` words,
which are joined to the message that first wrote them in its own text. A message replies to the message that wrote most
windows of its shallowest passage that is found. A passage of fewer words is one window and counts when no longer one
is found. Without a quote that is found a message replies to the one before it. Threads follow the replies, and
texts lose their quotes.

All joins run on (conversation, window) or (conversation, turn); windows are compared as text, so nothing is left to
confirm, and those that everybody writes are first reduced to the earliest turn, one row for each conversation. Only
conversations with quotes are cut into windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variscope.llm.scratch import running_total, stored

#: Turns of a conversation are ordered in chunks of so many, so that a huge conversation is no single task.
TURN_CHUNK = 1024
QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
# Lines that introduce a quote, in English, German, French and Spanish.
INTRODUCTION = r"(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t]*$"
#: Words of the windows by which passages are found.
WINDOW_WORDS = 5
RUN, LEVEL = "\x1e", "\x1f"


def lines_of(text: Column) -> Column:
    """Lines as structs of level (number of quote marks), body (without them) and introduces."""
    marks = lambda x: F.regexp_extract(x, QUOTE, 1)
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
            F.regexp_replace(x, QUOTE, "").alias("body"),
            x.rlike(INTRODUCTION).alias("introduces"),
        ),
    )


def words_of(text: Column) -> Column:
    """Words of a text in lower case; white space of any kind and length parts them."""
    plain = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def passages(lines: Column) -> Column:
    """Quoted runs as structs of level and words: lines of one level that follow each other are one passage."""

    def joined(x: Column, i: Column) -> Column:
        goes_on = F.get(lines, i - 1)["level"].eqNullSafe(x["level"])
        begin = F.concat(F.lit(RUN), x["level"].cast("string"), F.lit(LEVEL))
        return F.concat(F.when(goes_on, " ").otherwise(begin), F.translate(x["body"], RUN + LEVEL, "  "))

    runs = F.filter(F.split(F.array_join(F.transform(lines, joined), ""), RUN, -1), lambda x: (x != "") & ~x.startswith("0" + LEVEL))
    return F.transform(runs, lambda x: F.struct(F.substring_index(x, LEVEL, 1).cast("int").alias("level"), words_of(F.substring_index(x, LEVEL, -1)).alias("words")))


def windows(words: Column, size: Column) -> Column:
    """The different runs of ``size`` words."""
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when((F.size(words) >= size) & (size > 0), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def own_text(lines: Column) -> Column:
    """The lines that are no quote, without lines that only introduce one, and trimmed."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["introduces"] & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), "^\\s+|\\s+$", "")


def quoted_messages(messages: DataFrame) -> DataFrame:
    """conv, turn and ``quoted``, the turn that a message with quotes replies to; messages (conv, turn, _lines) without a quote that is found are left out."""
    found = messages.select("conv", "turn", F.explode(passages(F.col("_lines"))).alias("p")).select("conv", "turn", "p.level", "p.words")
    size = F.least(F.size("words"), F.lit(WINDOW_WORDS))
    quoted = found.select("conv", "turn", "level", size.alias("size"), F.explode(windows(F.col("words"), size)).alias("window")).distinct()
    # A few window sizes for each conversation with quotes.
    sizes = found.filter(F.size("words") > 0).groupBy("conv").agg(F.collect_set(size).alias("_sizes"))
    own = messages.join(sizes, "conv").select("conv", "turn", "_sizes", words_of(own_text(F.col("_lines"))).alias("_words"))
    written = own.select("conv", "turn", F.explode("_sizes").alias("size"), "_words")
    written = written.select("conv", "turn", "size", F.explode(windows(F.col("_words"), F.col("size"))).alias("window"))
    first = written.groupBy("conv", "size", "window").agg(F.min("turn").alias("origin"))
    linked = quoted.join(first, ["conv", "size", "window"]).filter("origin < turn")
    weight = linked.groupBy("conv", "turn", (F.col("size") < WINDOW_WORDS).alias("short"), "level", "origin").agg(F.count("*").alias("windows"), F.max("size").alias("size"))
    # Passages that are not short, then the shallowest level that is found, then the most text, then the latest message.
    order = F.struct("short", "level", -F.col("windows"), -F.col("size"), -F.col("origin"))
    return weight.groupBy("conv", "turn").agg(F.min_by("origin", order).alias("quoted"))


def parents(messages: DataFrame) -> DataFrame:
    """conv, turn, parent, linked_by for every different (conv, turn) of ``messages`` (conv, turn, _lines)."""
    best = quoted_messages(messages)
    turns = messages.select("conv", "turn").distinct().withColumn("_chunk", F.floor(F.col("turn") / TURN_CHUNK))
    ends = turns.groupBy("conv", "_chunk").agg(F.max("turn").alias("_last"))
    ends = ends.select("conv", "_chunk", F.lag("_last").over(Window.partitionBy("conv").orderBy("_chunk")).alias("_before"))
    ordered = turns.withColumn("_lag", F.lag("turn").over(Window.partitionBy("conv", "_chunk").orderBy("turn"))).join(ends, ["conv", "_chunk"])
    before = F.coalesce("_lag", "_before")
    return ordered.join(best, ["conv", "turn"], "left").select(
        "conv",
        "turn",
        F.coalesce("quoted", before).alias("parent"),
        F.when(F.col("quoted").isNotNull(), "quote").when(before.isNotNull(), "order").otherwise("none").alias("linked_by"),
    )


def threads(links: DataFrame) -> DataFrame:
    """Add ``thread`` (turn of the first message) and ``depth`` (replies above), by doubling of pointers.

    A parent is an earlier turn, so there are no cycles; rounds grow with the logarithm of the depth.
    """
    begun = links.withColumns({"up": F.coalesce("parent", "turn"), "depth": F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long"), "done": F.col("parent").isNull()})
    columns = ["conv", "turn", "parent", "linked_by", "up", "depth"]
    state = stored(begun, "threads")
    finished = state.filter("done").select(columns)
    while not state.filter("NOT done").isEmpty():
        # Rows that have reached their first message leave the loop; the others step on from where their pointer stands.
        above = state.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        open_ = state.filter("NOT done").select(columns).join(above, (F.col("conv") == F.col("_c")) & (F.col("up") == F.col("_t")))
        step = open_.select("conv", "turn", "parent", "linked_by", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_done").alias("done"), F.lit(True).alias("fresh"))
        # Only finished rows that may still be pointed at are looked up: they stay in the table, unread by the left side.
        rest = state.filter("done").withColumn("fresh", F.lit(False))
        both = stored(step.unionByName(rest), "threads")
        finished = finished.unionByName(both.filter("done AND fresh").select(columns))
        state = both.drop("fresh")
    return finished.select("conv", "turn", "parent", "linked_by", F.col("up").alias("thread"), "depth")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message with its place in its thread and without quotes.

    Returns conv, turn, role, text, quoted_lines, parent, linked_by ('quote', 'order' or 'none'), thread, depth
    and position (from 0: the order of a thread, in which each message follows the one it replies to).
    Messages of one conversation and turn are rows of one turn: they share its links and differ in position.
    A null conversation or turn links to nothing: it is a thread of its own with position 0. A null or
    empty text gives an empty text. Other columns are left out.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), lines_of(F.col(text)).alias("_lines"))
    placed = rows.filter("conv IS NOT NULL AND turn IS NOT NULL")
    links = threads(parents(placed.select("conv", "turn", "_lines")))
    bare = placed.select("conv", "turn", "role", own_text(F.col("_lines")).alias("text"), F.size(F.filter("_lines", lambda x: x["level"] > 0)).alias("quoted_lines"))
    named = bare.join(links, ["conv", "turn"]).withColumn("_chunk", F.floor(F.col("turn") / TURN_CHUNK))
    order = [F.col("turn"), F.col("role"), F.xxhash64("text")]
    counted = running_total(named, ["conv", "thread"], "_chunk", order, F.lit(1), "position")
    columns = ["conv", "turn", "role", "text", "quoted_lines", "parent", "linked_by", "thread", "depth", "position"]
    lone = rows.filter("conv IS NULL OR turn IS NULL").select(
        "conv", "turn", "role", own_text(F.col("_lines")).alias("text"), F.size(F.filter("_lines", lambda x: x["level"] > 0)).alias("quoted_lines"),
        F.lit(None).cast("long").alias("parent"), F.lit("none").alias("linked_by"), F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position"),
    )
    out = counted.select(columns).unionByName(lone.select(columns))
    return out.withColumnsRenamed({"conv": conv, "turn": turn, "role": role, "text": text})
