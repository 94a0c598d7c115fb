"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written `<|turn|>role<|text|>text<|end|>`. Every assistant turn becomes an
example of its own: all preceding turns are its context and only its reply lies
under the loss mask [loss_start, loss_end). Turns after the last assistant turn
become one more example without a mask, so that nothing is lost. Control
strings inside roles and texts get a backslash after their first character and
backslashes are doubled; taking one backslash away before any character
restores the text exactly.

Defined results: null role and null text are empty; turns sort by number (null
first), then role, then text, so repeated rows keep a fixed order; conversations
without an assistant turn have one example without a mask; a null conv_id is a
conversation of its own; an empty table gives no examples; other columns of the
input are not read. A conversation is one row while it is formatted, and its
examples together are as long as its turns times its replies: that is what the
method asks for, and what one conversation takes in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a template or a tokenizer could take for control marks.
CONTROL = r"([<\[])(?=\|[a-z_]{1,20}\|>|/?s>|/?INST\]|/?SYS>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order as an array of (turn, role, text)."""
    blank = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    return turns.select("conv_id", F.struct("turn", blank("role"), blank("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points; null where nothing is trainable)."""
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    made = conversations_of(turns).select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("p"),
    )
    whole = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    # the places of the assistant turns, and the end of the conversation if it isn't one
    places = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["reply"] | (i == F.size("p")))
    rows = made.select("conv_id", "p", F.posexplode(places).alias("example", "place"))
    last = F.element_at("p", F.col("place"))
    rows = rows.select("conv_id", "example", whole(F.slice("p", F.lit(1), F.col("place") - 1)).alias("context"), last.alias("last"))
    start = F.length("context") + F.length("last.head")
    return rows.select(
        "conv_id", "example", F.concat("context", "last.head", "last.body", F.lit(END)).alias("text"),
        F.when(F.col("last.reply"), start).cast("long").alias("loss_start"),
        F.when(F.col("last.reply"), start + F.length("last.body")).cast("long").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns in a formatted text, unescaped: array of (role, text)."""
    parts = F.split(text, r"<\|turn\|>")
    bodies = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.substr(x, F.lit(1), F.length(x) - len(END)))
    one = lambda x: F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.substr(x, F.instr(x, TEXT) + len(TEXT))).alias("text"))
    return F.transform(bodies, one)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the examples alone: its turns, what lies under the loss masks, and the length of all examples."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    parsed = examples.select("conv_id", "example", "text", F.coalesce(loss, F.lit("")).alias("loss"))
    return parsed.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    ).withColumn("turns", read_turns(F.col("longest"))).drop("longest")
