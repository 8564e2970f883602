"""Chat formatting (operator 5), Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role merge into a block, and the blocks are concatenated:

    <turn>ROLE<says>TEXT</turn>\\n            a block of one turn
    <turn>ROLE<says>TEXT<more>TEXT</turn>\\n  two adjacent turns of that role

Inside roles and texts a backslash is written ``\\b`` and ``<`` is written ``\\l``, so no
text holds a control string and reading back gives each text as it was.  The loss mask is
a list of spans (block, start, length in code points), one for each assistant text.

A long conversation is first formatted in chunks of ``CHUNK`` consecutive turn numbers by
separate tasks; only the few finished strings of its chunks come together.

Defined results: a null text is empty; a null role is the role named ``null``; turns sort
by turn number (null first), then role, then text, so ties and repeated rows have one
order; a null conv_id is a conversation; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512
TURN, SAYS, MORE, END = "<turn>", "<says>", "<more>", "</turn>\n"
SPAN = "array<struct<block:int,start:int,len:int>>"


def escape(c) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent sorted turns of one role as one block."""
    n = F.size(turns)
    new = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    return F.when(n > 0, F.transform(new, lambda i, k: F.struct(
        F.element_at(turns, i)["role"].alias("role"),
        F.transform(F.slice(turns, i, F.coalesce(F.get(new, k + 1), n + 1) - i),
                    lambda t: t["text"]).alias("texts"))))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans (the loss mask), n_blocks."""
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit("null")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                    F.floor(F.col("turn") / CHUNK).alias("chunk"))
    sorted_ = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chunks = t.groupBy("conv_id", "chunk").agg(sorted_.alias("turns")) \
        .select("conv_id", "chunk", merged(F.col("turns")).alias("blocks"))
    # a block as (role, its escaped texts joined, their lengths): what merging needs
    chunks = chunks.select("conv_id", "chunk", F.transform("blocks", lambda b: F.struct(
        escape(b["role"]).alias("role"),
        F.array_join(F.transform(b["texts"], escape), MORE).alias("body"),
        F.transform(b["texts"], lambda x: F.length(escape(x))).alias("lens"))).alias("blocks"))
    # blocks that touch over a chunk border and share a role become one
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("chunk", "blocks"))).alias("c")).select(
        "conv_id", F.flatten(F.col("c.blocks")).alias("b"))
    n = F.size("b")
    new = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at("b", i)["role"] != F.element_at("b", F.greatest(i - 1, F.lit(1)))["role"]))
    whole = whole.withColumn("new", new).withColumn("blocks", F.transform("new", lambda i, k: F.struct(
        F.element_at("b", i)["role"].alias("role"),
        F.array_join(F.transform(F.slice("b", i, F.coalesce(F.get("new", k + 1), F.size("b") + 1) - i),
                                 lambda x: x["body"]), MORE).alias("body"),
        F.flatten(F.transform(F.slice("b", i, F.coalesce(F.get("new", k + 1), F.size("b") + 1) - i),
                              lambda x: x["lens"])).alias("lens"))))
    text = F.array_join(F.transform("blocks", lambda x: F.concat(
        F.lit(TURN), x["role"], F.lit(SAYS), x["body"], F.lit(END))), "")
    head = len(TURN) + len(SAYS)

    def spans(x, k):
        """Spans of block k: each text starts after the texts and marks before it."""
        ends = F.aggregate(x["lens"], F.array().cast("array<int>"), lambda a, v: F.concat(
            a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + len(MORE), F.length(x["role"]) + head) + v)))
        return F.transform(F.arrays_zip(ends.alias("e"), x["lens"].alias("l")), lambda z: F.struct(
            k.cast("int").alias("block"), (z["e"] - z["l"]).cast("int").alias("start"),
            z["l"].cast("int").alias("len")))

    mask = F.flatten(F.transform("blocks", lambda x, k: F.when(
        x["role"] == F.lit(loss_role), spans(x, k)).otherwise(F.array().cast(SPAN))))
    return whole.select("conv_id", text.alias("formatted"), mask.alias("spans"),
                        F.size("blocks").cast("long").alias("n_blocks"))


def blocks_of(formatted) -> Column:
    """The blocks of a formatted conversation, without their end mark."""
    parts = F.split(formatted, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def turns_of(formatted) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    def turns(b):
        cut = F.split(F.substr(b, F.lit(len(TURN) + 1)), SAYS)
        return F.transform(F.split(cut[1], MORE), lambda x: F.struct(
            unescape(cut[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks_of(formatted), turns))


def loss_text(formatted, spans) -> Column:
    """All text under the mask, unescaped, in order."""
    blocks = blocks_of(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(
        F.element_at(blocks, s["block"] + 1), s["start"] + 1, s["len"]))), "")
