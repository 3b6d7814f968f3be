"""Conversations from messages that quote each other, by linking quoted lines.

A message's lines are parsed by quote level: level 0 is its own, level 1 is quoted
from the message it replies to. A quoted line is normalised, hashed and followed to
the latest earlier message of its conversation that has it as its own; the message
replies to the one that most of its level-1 lines lead to. Replies give each message a
thread and a depth, and a place in its conversation, without what it quoted.

A line is followed by order, not by pairing all that quote it with all that have it: one
row per quoted line comes out, however common the line. Orders within a
conversation are taken block by block, so that one conversation or line may hold any
share of all rows. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import stored

#: Turns, or depths, whose order is taken in one group.
BLOCK = 512


def parsed(text: Column) -> Column:
    """The lines of a message as (level, line), without their quote marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(?: ?>)+ ?", 0)
        level = F.length(marks) - F.length(F.regexp_replace(marks, ">", ""))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("line"))

    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), one)


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _lines(messages: DataFrame) -> DataFrame:
    """(conv, turn, line hash, quotes): the distinct lines of each level, blank ones left out."""
    normal = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["line"]).alias("l")))
    some = F.array_distinct(F.filter(normal, lambda x: x["l"] != ""))
    return messages.select("conv", "turn", F.explode(some).alias("x")).select(
        "conv", "turn", F.md5("x.l").alias("hash"), F.col("x.level").alias("quotes")
    )


def _followed(lines: DataFrame) -> DataFrame:
    """For each quoted line (conv, turn, hash, quotes), the latest earlier turn that has it as its own, if any."""
    key = ["conv", "hash"]
    lines = lines.withColumn("block", F.floor(F.col("turn") / BLOCK)).distinct()
    own_turn = F.when(F.col("quotes") == 0, F.col("turn"))
    # Within a block by order; a turn's own lines come after what it quotes.
    order = Window.partitionBy(*key, "block").orderBy("turn", F.desc("quotes"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = lines.withColumn("near", F.last(own_turn, ignorenulls=True).over(upto))
    # Before the block: one row for each, by order of blocks.
    blocks = lines.groupBy(*key, "block").agg(F.max(own_turn).alias("latest"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("latest").over(before)).select(*key, "block", "far")
    quoted = near.where("quotes > 0").join(blocks.where("far is not null"), [*key, "block"], "left")
    return quoted.select("conv", "turn", "hash", "quotes", F.coalesce("near", "far").alias("found")).where("found is not null")


def _replies(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to) of the messages that reply to one.

    Lines of the first level that leads anywhere decide: deeper ones count only where the
    levels above them are of no message, such as one that is empty. Of
    turns with equally many lines the latest is taken.
    """
    votes = _followed(_lines(messages)).groupBy("conv", "turn", "quotes", "found").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("quotes")).alias("level"), "n", "found")).alias("best"))
    return best.select("conv", "turn", F.col("best")["found"].alias("reply_to"))


def _depths(nodes: DataFrame, replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth), by following replies over doubled distances."""
    at = nodes.join(replies, ["conv", "turn"], "left").select(
        "conv",
        "turn",
        F.coalesce("reply_to", "turn").alias("root"),
        F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("reply_to").isNotNull().alias("open"),
    )
    at = stored(at, "depths")
    while at.where("open").limit(1).count():
        # Only messages that have not reached the first of their thread look further.
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        further = at.where("open").join(up, ["conv", "root"]).select(
            "conv", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open")
        )
        at = stored(further.unionByName(at.where("not open")), "depths")
    return at.drop("open")


def _places(nodes: DataFrame) -> DataFrame:
    """The rows with ``position``: their place in a conversation, by (root, depth, turn)."""
    group = ["conv", "root", "depth", "part"]
    # A part is a block of turns of one depth: a wide thread has several.
    nodes = nodes.withColumn("part", F.floor(F.col("turn") / BLOCK))
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("n"))
    # A deep thread has a part for each depth: they are added up block by block, too.
    sizes = sizes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = sizes.groupBy("conv", "root", "block").agg(F.sum("n").alias("n"))
    # Where few messages reply to any, a conversation has as many roots as messages: blocks of roots.
    roots = F.floor(F.col("root") / BLOCK)
    blocks = blocks.withColumn("roots", roots)
    sums = blocks.groupBy("conv", "roots").agg(F.sum("n").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("conv", "roots", upto(Window.partitionBy("conv").orderBy("roots")).alias("base"))
    among = upto(Window.partitionBy("conv", "roots").orderBy("root", "block"))
    blocks = blocks.withColumn("among", among).join(sums, ["conv", "roots"])
    blocks = blocks.select("conv", "root", "block", (F.col("base") + F.col("among")).alias("blocks"))
    before = Window.partitionBy("conv", "root", "block").orderBy("depth", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("parts", F.coalesce(F.sum("n").over(before), F.lit(0))).join(blocks, ["conv", "root", "block"])
    sizes = sizes.select(*group, (F.col("blocks") + F.col("parts")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("turn")) - 1
    placed = nodes.withColumn("inside", inside).join(sizes, group)
    return placed.withColumn("position", F.col("before") + F.col("inside")).drop("before", "inside", "part")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, root, depth, position, quoted, levels, body.

    ``messages`` has conv_id, turn, role, text. ``body`` is the text without quotes,
    ``quoted`` the number of quoted lines and ``levels`` the deepest level. A null text is
    empty. Messages with a null conv_id or turn cannot be ordered: they come with
    null links. Rows that repeat a conv_id and turn share links and position.
    No messages give no rows. Other columns are not looked at.
    """
    lines = parsed(F.col("text"))
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", lines.alias("lines")
    )
    rows = stored(rows, "parsed")
    known = rows.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    nodes = known.select("conv", "turn").distinct()
    replies = stored(_replies(known), "replies")
    linked = _places(_depths(nodes, replies)).join(replies, ["conv", "turn"], "left")
    found = rows.join(linked, ["conv", "turn"], "left")
    own = F.filter("lines", lambda x: x["level"] == 0)
    return found.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "reply_to",
        "root",
        "depth",
        "position",
        (F.size("lines") - F.size(own)).alias("quoted"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("levels"),
        F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("body"),
    )


def as_mails(messages: DataFrame, depth: int = 2) -> DataFrame:
    """Messages as mails that quote the one they answer, and what that one answered.

    A message answers the turn before it, every third one the turn before that. A
    quoted line gets one mark a level. Other columns are not looked at.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    texts = messages.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    mails = messages.withColumn("mail", F.coalesce("text", F.lit(""))).withColumn("at", F.col("turn"))
    for level in range(1, depth + 1):
        target = F.col("at") - F.when(F.col("at") % 3 == 0, 2).otherwise(1)
        told = texts.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "said")
        mails = mails.withColumn("at", target).join(told, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("t")), "left")
        lines = F.transform(F.split("said", "\n"), lambda x: F.concat(F.lit("> " * level), x))
        mails = mails.withColumn("mail", F.concat_ws("\n", "mail", F.array_join(lines, "\n"))).drop("c", "t", "said")
    return mails.select("conv_id", "turn", "role", F.col("mail").alias("text"))
