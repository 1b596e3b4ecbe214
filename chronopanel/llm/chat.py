"""Quotation linking: quoted passages of messages joined to the messages they come from, and replies put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, stored, text_of

#: A quoted line: marks, each with up to one blank before it, then the passage.
QUOTE = r"(?s)^((?:[ \t]?>)+)[ \t]?(.*)$"


def passage_key(line: Column) -> Column:
    """Lower-cased letters and digits with single blanks; equal for passages that differ in case, marks or spacing."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, line) of every line of every message: its nested quote level and its text without marks."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(text_of("text"), "\r?\n")).alias("at", "raw"))
    marks = F.regexp_extract("raw", QUOTE, 1)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return lines.select("conv_id", "turn", "at", level.alias("level"), F.when(level > 0, F.regexp_extract("raw", QUOTE, 2)).otherwise(F.col("raw")).alias("line"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, linked to what they quote and put in reply order.

    Every non-empty quoted line is hashed in its normal form and joined, within its conversation, to the earliest
    earlier turn that has it as a line of its own. A message replies to the turn that most of its lines of the lowest
    linked level come from; ties go to the later turn. Without a link it starts a thread.

    Returns conv_id, turn, role, reply_to (turn or null), root_turn, depth, n_quoted, n_linked (quoted lines, and those
    with an original) and body (own lines joined by newline; the text itself if it has no quotes). Replies come after
    what they answer when sorted by conv_id, root_turn, depth, turn: ``in_reply_order`` deals and sorts them so.

    Null text is empty. Rows with a null conv_id or turn link to nothing and are their own roots. Rows of one (conv_id,
    turn) count as one message when linking, and each gives a row. Lines and links are dealt by conversation and hash or
    turn, so one long conversation is spread; per hash only the earliest turn is kept, so a common line makes no pairs.
    """
    lines = parsed(messages)
    own = hash128(F.col("conv_id"), F.col("key"))
    keyed = lines.withColumn("key", passage_key(F.col("line"))).where("key != '' and conv_id is not null and turn is not null")
    keyed = keyed.select("conv_id", "turn", "level", own.alias("h")).select("conv_id", "turn", "level", F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
    originals = keyed.where("level = 0").groupBy("ha", "hb").agg(F.min("turn").alias("source"))
    quoted = stored(keyed.where("level > 0").groupBy("conv_id", "turn", "level", "ha", "hb").agg(F.count("*").alias("n")), "quoted")
    linked = quoted.join(originals, ["ha", "hb"]).where("source < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), F.col("n"), F.col("source"))).alias("reply_to"), F.sum("n").alias("n_linked"))
    parents = stored(best, "replies")
    roots = _roots(parents.select("conv_id", "turn", "reply_to"))
    counts = quoted.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_quoted"))
    about = stored(counts.join(parents, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left"), "reply-facts")
    lines_of = F.split(text_of("text"), "\r?\n")
    body = F.when(F.exists(lines_of, lambda x: x.rlike(QUOTE)), F.array_join(F.filter(lines_of, lambda x: ~x.rlike(QUOTE)), "\n")).otherwise(text_of("text"))
    copies = F.greatest(F.col("__copies"), F.lit(1))
    repeated = messages.groupBy("conv_id", "turn").agg(F.count("*").alias("__copies")).where("__copies > 1")
    out = messages.select("conv_id", "turn", "role", body.alias("body")).join(about, ["conv_id", "turn"], "left").join(stored(repeated, "repeated"), ["conv_id", "turn"], "left")
    each = lambda c: F.floor(F.coalesce(c, F.lit(0)) / F.coalesce(copies, F.lit(1))).cast("long")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), each(F.col("n_quoted")).alias("n_quoted"), each(F.col("n_linked")).alias("n_linked"), "body"
    )


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by pointer jumping along reply_to; the depth halves each round."""
    state = parents.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"))
    while not state.isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = stored(state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if state.where("moved").isEmpty():
            break
    return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Range-dealt by thread and sorted: conversations read from top to bottom, however long one is."""
    order = ["conv_id", "root_turn", "depth", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
