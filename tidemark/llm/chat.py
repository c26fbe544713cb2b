"""Chat formatting by prefix-target expansion.

DataFrame functions only.  Every assistant turn becomes one training example:
all turns before it are context, and only that reply is trainable.  Turns
after a conversation's last reply (or a conversation without one) form one
more example without a target, so that no turn is lost.

Template of a turn: ``<turn ROLE>TEXT</turn>`` and a line feed.  In ROLE and
TEXT a backslash is written ``\\b``, ``<`` is ``\\l``, ``>`` is ``\\g`` and
``#`` is ``\\h``; so no text can hold a turn mark or another control string,
and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    """A form of ``text`` without ``<``, ``>`` and ``#``; every backslash in it
    starts one of the codes above."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("#", "\\h"), (">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def prefix_target_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                           role_col: str = "role", text_col: str = "text",
                           target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, mask_start, mask_length) per example.

    Turns are ordered by turn number, ties by role, then text; null role and
    text count as empty; a null turn number comes first.  ``example`` counts
    from 0 within the conversation.  The mask marks the target's (escaped) text
    in code points of ``formatted``; an example without target has length 0
    and a null start.  Repeated rows are turns of their own.  Rows with a null
    conversation id form one conversation.  An empty table gives no example;
    other columns play no part.

    A conversation is one row here: its last example is the whole conversation
    in one string, so this adds nothing to what the method has to hold.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = turns.select(F.col(conv_col).alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = base.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == F.lit(target_role)).alias("is_target"),
        F.transform("ts", lambda t: format_turn(t["role"], t["text"])).alias("parts"),
        F.transform("ts", lambda t: F.char_length(escape(t["text"]))).alias("lengths"))
    n = F.size("parts")
    last = F.element_at("is_target", -1)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("is_target"), i) | (i == n))
    rows = convs.withColumn("last_is_target", last).select(
        "conv_id", "parts", "lengths", "is_target", F.posexplode(ends).alias("example", "upto"))
    targeted = F.element_at("is_target", F.col("upto"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "")
    length = F.when(targeted, F.element_at("lengths", F.col("upto"))).otherwise(0)
    return rows.select("conv_id", "example", formatted.alias("formatted"), targeted.alias("_t"),
                       length.cast("long").alias("mask_length")).select(
        "conv_id", "example", "formatted",
        F.when(F.col("_t"), (F.char_length("formatted") - len(CLOSE) - F.col("mask_length")).cast("long"))
        .alias("mask_start"), "mask_length")


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example: the exact inverse."""
    pieces = F.split(formatted, CLOSE.replace("\n", "\\n"))
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(bodies, lambda b: F.struct(
        unescape(F.substring_index(F.substring(b, len(OPEN) + 1, 2147483647), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(b, MIDDLE, -1)).alias("text")))


def target_text(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the mask (empty without one)."""
    return F.when(start.isNull(), F.lit("")).otherwise(
        unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int"))))
