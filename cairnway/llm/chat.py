"""Chat formatting by prefix-target expansion, native DataFrame operations only.

Every assistant turn becomes one example: all turns up to it are its text, and
only its own reply is trainable.  Turns after the last assistant turn make a
tail example without a trainable span, so that no turn is lost.

Template: ``<turn ROLE>`` newline, text, ``</turn>`` newline.  Inside roles and
texts a backslash becomes ``\\s``, ``<`` becomes ``\\l`` and ``>`` becomes
``\\g``; so no text can form a mark, and undoing it is exact.

Conversations are gathered by id with their turns in order; a conversation is
the unit of formatting, and every example is a row of its own.

Defined results: null texts and roles are empty; turns are ordered by turn
(nulls first), then role, then text, and repeated rows are kept; a null id is a
conversation of its own; an empty table gives an empty result; other input
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example`` (from 0), ``formatted, loss_start, loss_length, is_last``.

    The loss mask is the span of ``loss_length`` code points from ``loss_start`` (from 0); both are null in a tail example.
    """
    mark = F.concat(F.lit("<turn "), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(">\n"))
    body = escape(F.coalesce(F.col(text), F.lit("")))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("raw"),
            F.concat(mark, body, F.lit(TURN_END)).alias("formatted"),
            F.char_length(body).alias("n"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Ends of the prefixes: each assistant turn, and the last turn if it is not one.
    ends = F.expr("filter(sequence(1, size(ts)), i -> ts[i - 1].role = 'assistant' or i = size(ts))")
    examples = convs.select("conv_id", "ts", F.posexplode(ends).alias("example", "end"))
    last = F.expr("ts[end - 1]")
    formatted = F.expr("array_join(transform(slice(ts, 1, end), t -> t.formatted), '')")
    target = last["role"] == "assistant"
    shaped = examples.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        F.when(target, last["n"]).cast("long").alias("loss_length"),
        (F.col("end") == F.size("ts")).alias("is_last"),
    )
    start = F.char_length("formatted") - F.lit(len(TURN_END)) - F.col("loss_length")
    return shaped.select("conv_id", "example", "formatted", start.cast("long").alias("loss_start"), "loss_length", "is_last")


def masked_text(formatted: Column | str = "formatted") -> Column:
    """The trainable text of an example, unescaped (null in a tail example)."""
    return unescape(F.substring(formatted, F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))


def parse_turns(formatted: Column) -> Column:
    """Reads a formatted text back into ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(7)), ">\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ">\n") + 2)).alias("text"),
        ),
    )
