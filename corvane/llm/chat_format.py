"""Chat formatting in Spark expressions: sorted turn structs, merged and concatenated.

A conversation's turns are collected as structs and sorted by turn, role and text; adjacent
turns of one role are merged into a block by array aggregation. A block is written as

    <turn ROLE>
    text<and>
    text</turn>

with ``<and>`` between merged turns, so that reading back gives the turns as they were. Inside
texts and roles a backslash becomes ``\\b`` and ``<`` becomes ``\\l``; no control string can then
occur in a text, and undoing both in the other order is exact. In roles ``>`` and line feeds are
escaped too.

The loss mask is a list of spans (start, length in code points) of the formatted string: the text
of every assistant turn, without its marks. Null texts and roles are empty; a null turn sorts first;
repeated rows are turns of their own; rows of a null conv_id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, NAMED, AND, CLOSE = "<turn ", ">\n", "<and>\n", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) for turns (conv_id, turn, role, text, ...)."""
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = "array<struct<role:string,texts:array<string>>>"

    def merge(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        same = F.when(F.size(blocks) > 0, last["role"] == t["role"]).otherwise(False)
        return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh))).cast(block)

    def pieces(b: Column) -> Column:
        head = lambda i: F.when(i == 0, F.concat(F.lit(OPEN), _role_out(b["role"]), F.lit(NAMED))).otherwise(AND)
        tail = lambda i: F.when(i == F.size(b["texts"]) - 1, CLOSE).otherwise("")
        return F.transform(b["texts"], lambda x, i: F.struct(head(i).alias("head"), escaped(x).alias("body"), tail(i).alias("tail"), (b["role"] == ASSISTANT).alias("loss")))

    def span(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        length = F.length(p["body"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(acc["spans"])
        return F.struct((start + length + F.length(p["tail"])).alias("at"), spans.alias("spans"))

    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    merged = sorted_turns.select("conv_id", F.aggregate("turns", F.array().cast(block), merge).alias("blocks"))
    cut = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("pieces", zero, span, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, merged ones as they were before."""

    def block(b: Column) -> Column:
        role = _role_in(F.substring_index(F.substring(b, len(OPEN) + 1, F.length(b)), NAMED, 1))
        body = F.substring(b, F.locate(NAMED, b) + len(NAMED), F.length(b))
        return F.transform(F.split(body, AND, -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE, -1), lambda b: b != ""), block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
