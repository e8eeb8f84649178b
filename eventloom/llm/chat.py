"""Chat formatting: a conversation log folded into messages, then rendered with a loss mask.

The log has one row per event: ``conv_id``, ``turn``, ``seq`` (order within a turn), ``kind``, ``role``, ``text``; other
columns are ignored. Kinds: ``message`` (or null) opens a message, ``delta`` appends to it, ``edit`` replaces its text,
``regenerate`` empties it for the deltas that follow. Events before a turn's first ``message`` form a message of their own.

A message's role is the first that its events name.

Nulls: text and role count as empty, a null turn comes first, null ``conv_id`` is a conversation like any other. Ties in
``seq`` go by kind (message, regenerate, edit, delta), role, text. Repeated ``message`` rows are repeated messages. A log
without rows gives no conversations. Events are folded per (conversation, turn), so a conversation with a large part of all
rows is spread over tasks until its messages are joined to the one text that it is.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HEAD, ENDS = "### ", "</turn>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    """Doubles each backslash and puts one inside each control string, so none is left in the text."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(ENDS), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("#\\## "))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(": "), F.lit(":\\ "))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(log: DataFrame) -> DataFrame:
    """``conv_id, turn, message, role, text``: the final messages."""
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    e = log.select("conv_id", "turn", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                   F.when(kind == "message", 0).when(kind == "regenerate", 1).when(kind == "edit", 2).otherwise(3).alias("_kind"))
    w = W.partitionBy("conv_id", "turn").orderBy("seq", "_kind", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.select("*", F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0)).over(w).alias("message"), F.count(F.lit(1)).over(w).alias("_pos"))
    # what came before the last replacement of a message's text is gone
    all_of = W.partitionBy("conv_id", "turn", "message")
    since = F.max(F.when(F.col("_kind") < 3, F.col("_pos"))).over(all_of)
    role = F.coalesce(F.min(F.when(F.col("role") != "", F.struct("_pos", "role"))).over(all_of)["role"], F.lit(""))
    e = e.withColumns({"_since": since, "role": role}).where(F.col("_since").isNull() | (F.col("_pos") >= F.col("_since")))
    said = F.when(F.col("_kind") == 1, F.lit("")).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("_pos", said.alias("text"))))
    return e.groupBy("conv_id", "turn", "message").agg(F.first("role").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, segments, formatted``: ``formatted`` is the segments' texts joined; those with ``loss`` are learned."""
    m = messages.select("conv_id", "turn", "message", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"),
                        (F.col("role") == LEARNED).alias("loss"))
    c = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "message", "head", "body", "loss"))).alias("_m"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("_m", lambda x: F.array(seg(x["head"], F.lit(False)), seg(x["body"], x["loss"]), seg(F.lit(ENDS + "\n"), F.lit(False)))))
    return c.select("conv_id", segments.alias("segments")).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def format_chats(log: DataFrame) -> DataFrame:
    return render(fold(log))


def turns(formatted: Column) -> Column:
    """Reads a formatted conversation back: an array of (role, text)."""
    pieces = F.split(formatted, ENDS + "\n", -1)
    head = lambda p: F.substring_index(p, ": ", 1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substr(head(p), F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(p, F.char_length(head(p)) + 3)).alias("text")))


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
