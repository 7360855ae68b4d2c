"""Chat formatting in Spark expressions only.

A conversation's turns are sorted, neighbours of one role merged into a block, and blocks concatenated:

    <|start|>ROLE<|text|>TEXT<|more|>TEXT<|end|>

``<|more|>`` parts the merged turns, so nothing of the input is lost. Inside roles and texts a backslash becomes two and ``<|`` becomes
``<\\|``; so ``<|`` occurs in marks alone, and unescaping takes away one backslash before any character. The output is a list
of segments, each in or out of the loss; their concatenation is the formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, MORE, END = "<|start|>", "<|text|>", "<|more|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted) of rows of conv_id, turn, role, text; segments are (text, loss).

    Null roles and texts are empty; a null turn comes first; equal turns are in order of role, then text; rows that repeat are
    turns of their own; a null conv_id is a conversation too. Only the loss role's texts are in the loss. Very long texts stay whole: a conversation is
    one row. Other columns are left out, whatever their names. No rows: no conversations.
    """
    none = F.lit("")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    heads = F.filter(places, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    marked = turns.withColumn("heads", heads).withColumn("ends", F.concat(F.slice("heads", F.lit(2), F.size("turns")), F.array(F.size("turns"))))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = lambda *parts: F.array(piece(F.concat(*parts), F.lit(False)))

    def part(t: Column, k: Column) -> Column:
        own = F.array(piece(escaped(t["text"]), t["role"] == LOSS_ROLE))
        return F.when(k == 0, own).otherwise(F.concat(mark(F.lit(MORE)), own))

    def block(head: Column, end: Column) -> Column:
        merged = F.slice("turns", head + 1, end - head)
        role = escaped(F.get("turns", head)["role"])
        return F.concat(mark(F.lit(START), role, F.lit(TEXT)), F.flatten(F.transform(merged, part)), mark(F.lit(END)))

    made = marked.select("conv_id", F.flatten(F.zip_with("heads", "ends", block)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    quoted = lambda mark: mark.replace("|", r"\|")
    blocks = F.filter(F.split(text, quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        sides = F.split(block, quoted(TEXT))
        role = unescaped(F.substr(F.get(sides, F.lit(0)), F.lit(len(START) + 1)))
        return F.transform(F.split(F.get(sides, F.lit(1)), quoted(MORE)), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(conversations: DataFrame) -> DataFrame:
    """What the output says of each conversation, read back from it."""
    parsed = conversations.withColumn("turns", read_back(F.col("formatted")))
    parsed = parsed.withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
