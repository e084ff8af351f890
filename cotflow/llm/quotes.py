"""Quotation linking: who quotes whom, and conversations in reply order without the quotes.

Built-in column expressions and joins only.

A line's quote level is the number of ``>`` marks it begins with (blanks between them allowed). A
passage is a run of lines of one level without an empty line. Quoted passages and the passages
that messages write themselves (level 0) are normalised (lower case, runs of white space as one
space) and hashed; within a conversation a quoted passage is linked to the first message that wrote
it, if that message is earlier. The latest message linked from a level-1 passage is the one replied
to. A message without such a link begins a thread. Threads come in order of their first message,
messages of a thread in order of time, so every reply follows what it answers.

A line that introduces a quote ("... wrote:" just above it) goes with the quote.

Aggregates come before joins, so a passage that thousands of messages share is one row on its side;
positions are counted per range of rows first, so no task holds a whole conversation.

Defined results: a null text is an empty message; a null conversation or time is kept, links to
nothing and starts a thread of its own; repeated rows of one time get positions next to each other
in any order, and count as one message when others reply to it. The empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cotflow.functions.lambdas import computed_once, let
from cotflow.llm.frames import shuffle_parts, staged

RESULT = [
    "conv_id", "turn", "thread", "parent_turn", "depth", "position", "n_quoted", "n_linked", "own_text",
]

# Marks between passages and after a passage's level; taken out of the texts first.
NEXT, LEVEL = "\x01", "\x02"
PREFIX = r"^[ \t]*(?:>[ \t]*)+"
INTRODUCES = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _lines(text: Column) -> Column:
    """The lines as structs of level and content."""
    plain = F.translate(F.coalesce(text, F.lit("")), NEXT + LEVEL + "\r", "  ")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, PREFIX, 0)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
            F.substring(line, F.length(marks) + 1, F.length(line)).alias("content"),
        )

    return F.transform(F.split(plain, "\n"), parse)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line["content"], "\t\x0b\x0c", "   ")) == ""


def _introduces(lines: Column, line: Column, i: Column) -> Column:
    """A line that ends like an attribution, right above a deeper quote."""
    return line["content"].rlike(INTRODUCES) & F.coalesce(F.get(lines, i + 1)["level"] > line["level"], F.lit(False))


def passages(lines: Column) -> Column:
    """Array of (level, normalised text); linear in the number of lines."""
    # Introductions end a passage like an empty line. ``let``: the lambdas below look at
    # neighbours, and would otherwise make the whole array anew for every line.
    blanked = F.transform(
        lines,
        lambda line, i: F.struct(
            line["level"].alias("level"), F.when(_introduces(lines, line, i), "").otherwise(line["content"]).alias("content")
        ),
    )
    return let(blanked, _runs)


def _runs(lines: Column) -> Column:
    """The passages of lines whose introductions are empty already."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["level"] == b["level"]) & ~_blank(a) & ~_blank(b), F.lit(False))

    def mark(line: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        return F.concat(
            F.when(same(before, line), F.lit("")).otherwise(F.concat(line["level"].cast("string"), F.lit(LEVEL))),
            line["content"],
            F.when(same(line, after), F.lit("\n")).otherwise(F.lit(NEXT)),
        )

    runs = F.split(F.array_join(F.transform(lines, mark), ""), NEXT)
    parsed = F.transform(
        runs,
        lambda run: F.struct(
            F.substring_index(run, LEVEL, 1).try_cast("int").alias("level"),
            F.trim(F.regexp_replace(F.lower(F.substring_index(run, LEVEL, -1)), r"[ \t\n\x0b\x0c]+", " ")).alias("text"),
        ),
    )
    return F.filter(parsed, lambda p: p["text"] != "")


def own_text(lines: Column) -> Column:
    """What the message says itself: lines of level 0, without introductions of quotes."""
    kept = F.filter(lines, lambda line, i: (line["level"] == 0) & ~_introduces(lines, line, i))
    joined = F.array_join(F.transform(kept, lambda line: line["content"]), "\n")
    return F.regexp_replace(joined, r"^[ \t\n]+|[ \t\n]+$", "")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per message, with the columns of RESULT."""
    named = messages.select(
        messages[conv_col].alias("conv_id"), messages[turn_col].alias("turn"), messages[text_col].alias("text")
    )
    parsed = computed_once(named, ["conv_id", "turn"], _lines(F.col("text")).alias("lines"))
    parsed = staged(
        parsed.select("conv_id", "turn", own_text(F.col("lines")).alias("own_text"), passages(F.col("lines")).alias("passages"))
        .withColumn("message", F.monotonically_increasing_id()),
        "quotes-parsed",
    )
    said = parsed.select("conv_id", "turn", "message", F.explode("passages").alias("p")).select(
        "conv_id", "turn", "message", F.col("p.level").alias("level"), F.xxhash64("p.text").alias("hash")
    )
    originals = (
        said.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original")).where("original IS NOT NULL")
    )
    quoted = said.where("level > 0")
    links = quoted.join(originals, ["conv_id", "hash"], "left").withColumn("linked", F.col("original") < F.col("turn"))
    per_message = links.groupBy("message").agg(
        F.count("*").alias("n_quoted"),
        F.count_if("linked").alias("n_linked"),
        F.max(F.when(F.col("linked") & (F.col("level") == 1), F.col("original"))).alias("parent_turn"),
    )
    known = staged(
        parsed.drop("passages").join(per_message, "message", "left").na.fill(0, ["n_quoted", "n_linked"]), "quotes-linked"
    )
    roots = thread_roots(known.select("conv_id", "turn", "parent_turn"))
    placed = known.join(roots, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("thread", "turn").alias("thread"), "parent_turn",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", "n_linked", "own_text",
    )
    return with_positions(placed).select(*RESULT)


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) by pointer doubling: the number of rounds is the logarithm
    of the longest chain of replies, and only messages whose thread is still open take part."""
    turns = (
        replies.dropna(subset=["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn"))
    )
    state = staged(
        turns.select(
            "conv_id", "turn", F.coalesce("parent_turn", "turn").alias("thread"),
            F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("long").alias("depth"),
            F.col("parent_turn").isNull().alias("closed"),
        ),
        "quotes-roots",
    )
    known, still_open = state.where("closed"), state.where("NOT closed")
    while not still_open.isEmpty():
        ahead = known.unionByName(still_open).select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"),
            F.col("depth").alias("more"), F.col("closed").alias("ends"),
        )
        moved = staged(
            still_open.join(ahead, ["conv_id", "thread"]).select(
                "conv_id", "turn", F.col("further").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"),
                F.col("ends").alias("closed"),
            ),
            "quotes-roots",
        )
        known, still_open = known.unionByName(moved.where("closed")), moved.where("NOT closed")
    return known.drop("closed")


def with_positions(rows: DataFrame) -> DataFrame:
    """position: place in the conversation by (thread, turn), counted from 0.

    Rows are dealt out by ranges of that order; a row's position is its rank in its range plus the
    conversation's rows in earlier ranges.
    """
    ranged = staged(
        rows.repartitionByRange(shuffle_parts(rows.sparkSession), "conv_id", "thread", "turn").withColumn("part", F.spark_partition_id()),
        "quotes-ranges",
    )
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("conv_id").alias("of_conv"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("thread", "turn"))
    return (
        ranged.withColumn("rank", rank)
        .join(before, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")))
        .withColumn("position", (F.col("rank") + F.col("before") - 1).cast("long"))
        .drop("rank", "before", "part", "of_conv", "of_part")
    )


def answered(turn: Column) -> Column:
    """Which turn a derived message answers: the one before, every third time the one before that."""
    return turn - 1 - (turn % 3 == 2).cast("int")


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Mail-like messages from turns: each quotes the turn it answers, and what that one answered."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    one = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))

    def earlier(n: int) -> DataFrame:
        return one.select(
            F.col("conv_id"), F.col("turn").alias(f"turn{n}"), F.col("text").alias(f"text{n}"), F.col("role").alias(f"role{n}")
        )

    def quote(text: Column, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)))

    both = (
        turns.withColumn("turn1", answered(F.col("turn"))).withColumn("turn2", answered(F.col("turn1")))
        .join(earlier(1), ["conv_id", "turn1"], "left")
        .join(earlier(2), ["conv_id", "turn2"], "left")
    )
    inner = F.concat(F.lit("\n> "), F.col("role2"), F.lit(" wrote:\n"), quote(F.col("text2"), ">> "))
    body = F.concat(
        F.coalesce("text", F.lit("")),
        F.coalesce(
            F.concat(F.lit("\n\n"), F.col("role1"), F.lit(" wrote:\n"), quote(F.col("text1"), "> "), F.coalesce(inner, F.lit(""))),
            F.lit(""),
        ),
    )
    return both.select("conv_id", "turn", "role", body.alias("text"))
