"""Conversations as training text, with DataFrame functions only.

A run of turns of one role is one block: `[INST]`..`[/INST]` for the user, `[SYS]`..`[/SYS]`
for the system, `[ANS]`..`</s>` for the assistant and `[ROLE]`name`[:]`..`[/ROLE]` for any
other role. Texts within a block are divided by `[NEXT]`, a conversation begins with `<s>`.
Where a text itself holds such a mark, with any number of backslashes behind its first
character, it gets one backslash more; taking one away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
BEGIN, NEXT, NAMED, AFTER_NAME, END_NAMED = "<s>", "[NEXT]", "[ROLE]", "[:]", "[/ROLE]"
LEARNED = "assistant"

_SQUARE = r"/?(?:SYS|INST|ANS|ROLE)|NEXT|:"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"\[(\\*)({_SQUARE})\]", r"[\\$1$2]")
    return F.regexp_replace(text, r"<(\\*)(/?s)>", r"<\\$1$2>")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"\[\\(\\*)({_SQUARE})\]", r"[$1$2]")
    return F.regexp_replace(text, r"<\\(\\*)(/?s)>", r"<$1$2>")


def _mark(role: Column, i: int) -> Column:
    other = F.concat(F.lit(NAMED), escaped(role), F.lit(AFTER_NAME)) if i == 0 else F.lit(END_NAMED)
    for name, marks in BLOCKS.items():
        other = F.when(role == name, F.lit(marks[i])).otherwise(other)
    return other


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the stretches of
    `formatted` (start, end; code points from 0, end exclusive) that hold assistant texts.

    Turns stand in order of turn, then role, then text, nulls first, so ties and repeated
    rows have a fixed order. A null text or role is empty. Turns without a conversation id
    make up a conversation without id. No rows give no rows; other columns are not looked
    at. A conversation is one output row, so it must fit one.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select(
        "conv_id", "role", escaped(F.col("text")).alias("body"), F.row_number().over(order).alias("pos"),
        F.lag("role").over(order).alias("before"), F.lead("role").over(order).alias("behind"))
    same_before = F.col("role").eqNullSafe(F.col("before"))
    head = F.when(same_before, F.lit(NEXT)).otherwise(_mark(F.col("role"), 0))
    head = F.when(F.col("pos") == 1, F.concat(F.lit(BEGIN), head)).otherwise(head)
    tail = F.when(F.col("role").eqNullSafe(F.col("behind")), F.lit("")).otherwise(_mark(F.col("role"), 1))
    rows = rows.withColumns({"head": head, "tail": tail})
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.length("head") + F.length("body") + F.length("tail")).cast("long")).over(so_far)
    rows = rows.withColumn("end", end - F.length("tail"))
    learned = F.when(F.col("role") == LEARNED, F.struct(
        (F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end")))
    turn = F.struct("pos", F.concat("head", "body", "tail").alias("piece"), learned.alias("loss"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        "conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.array_compact(F.col("t.loss")).alias("loss_spans"))


def read_back(formatted_text: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    blocks = F.split(F.substr(formatted_text, F.lit(len(BEGIN) + 1)), r"(?=\[(?:SYS|INST|ANS|ROLE)\])")
    name = unescaped(F.regexp_extract(F.lit(""), "()", 1))

    def turns(block: Column) -> Column:
        name = unescaped(F.regexp_extract(block, r"(?s)\A\[ROLE\](.*?)\[:\]", 1))
        for role, (begin, _) in BLOCKS.items():
            name = F.when(block.startswith(begin), F.lit(role)).otherwise(name)
        body = F.regexp_replace(
            block, r"(?s)\A\[(?:SYS|INST|ANS)\]|\A\[ROLE\].*?\[:\]|(?:\[/(?:SYS|INST|ROLE)\]|</s>)\z", "")
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(name.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(formatted_text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
