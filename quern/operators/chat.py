"""Conversations: rendering, and which tokens are learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn marks and the end of a message (fixed values).
ROLES = {"user": "<|user|>", "assistant": "<|assistant|>", "system": "<|system|>"}
END = "<|endoftext|>"
#: What the default tokeniser takes as tokens of a rendered conversation.
TOKEN = r"<\|[a-z]+\|>|\n|[^\s<]+|<"


def mark(role: Column) -> Column:
    """The role's mark; an unknown role is an error."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[role]
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))))


def turn(role: Column, text: Column) -> Column:
    return F.concat(mark(role), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def render(conversations: DataFrame, prompt: bool = False, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, rendered): turns in order, one a line block, a trailing line feed; prompt adds the assistant's mark."""
    turns = conversations.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(order, turn(F.col("role"), F.col("text")).alias("t")))).alias("m"))
    parts = F.col("m.t")
    if prompt:
        parts = F.concat(parts, F.array(F.lit(ROLES["assistant"])))
    return turns.select(conv, F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("rendered"))


def loss_spans(conversations: DataFrame, conv: str = "conv_id", order: str = "turn", longest: int | None = None) -> DataFrame:
    """(conv, order, role, start, end): the tokens of each message that are learned from, end exclusive.

    Positions are those of labels, which are shifted left by one. Messages that aren't the assistant's are masked, and
    with one before an assistant's message also that message's mark and line feed, being the prompt. Token counts add
    up because the tokeniser never joins what a line feed parts.
    """
    block = F.concat(turn(F.col("role"), F.col("text")), F.lit("\n"))
    w = Window.partitionBy(conv).orderBy(order)
    rows = conversations.withColumn("_n", F.regexp_count(block, F.lit(TOKEN)))
    rows = rows.withColumn("_end", F.sum("_n").over(w)).withColumn("_start", F.col("_end") - F.col("_n"))
    prompted = F.coalesce(F.lag("role").over(w) != "assistant", F.lit(False))
    own = F.col("role") == "assistant"
    start = F.when(own, F.col("_start") + F.when(prompted, 2).otherwise(0)).otherwise(F.col("_end"))
    end = F.col("_end") if longest is None else F.least(F.col("_end"), F.lit(longest))
    rows = rows.withColumn("start", F.greatest(start - 1, F.lit(0)).cast("int")).withColumn("end", F.greatest(end - 1, F.lit(0)).cast("int"))
    return rows.select(conv, order, "role", "start", F.when(own, F.greatest("start", "end")).otherwise(F.col("start")).alias("end"))


def loss_counts(conversations: DataFrame, conv: str = "conv_id", order: str = "turn", longest: int | None = None) -> DataFrame:
    """(conv, num_labels, num_loss): labels, and those that are learned from; conversations without any loss go."""
    block = F.concat(turn(F.col("role"), F.col("text")), F.lit("\n"))
    total = conversations.groupBy(conv).agg(F.sum(F.regexp_count(block, F.lit(TOKEN))).alias("_n"))
    if longest is not None:
        total = total.withColumn("_n", F.least("_n", F.lit(longest)))
    loss = loss_spans(conversations, conv, order, longest).groupBy(conv).agg(F.sum(F.col("end") - F.col("start")).alias("num_loss"))
    return total.join(loss, conv).select(conv, (F.col("_n") - 1).cast("long").alias("num_labels"), "num_loss").filter("num_loss > 0")


def labels(conversations: DataFrame, conv: str = "conv_id", order: str = "turn", ignore: str = "-100") -> DataFrame:
    """(conv, inputs, labels): the tokens but for the last, and the next tokens with masked ones as `ignore`."""
    spans = loss_spans(conversations, conv, order).groupBy(conv).agg(F.collect_list(F.struct("start", "end")).alias("_s"))
    rows = render(conversations, conv=conv, order=order).join(spans, conv).withColumn("_t", F.regexp_extract_all("rendered", F.lit(TOKEN), F.lit(0)))
    following = F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0)))
    learned = F.transform(following, lambda t, i: F.when(F.exists("_s", lambda s: (s["start"] <= i) & (i < s["end"])), t).otherwise(F.lit(ignore)))
    return rows.select(conv, F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))).alias("inputs"), learned.alias("labels"))


def conversation_stats(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    return conversations.groupBy(conv).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.sum(F.length("text")).alias("chars"),
        F.min_by("role", "turn").alias("first_role"),
    )
