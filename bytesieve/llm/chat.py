"""Chat formatting with Spark expressions only.

Turns of a conversation are collected and sorted as structs, neighbours of one role are merged by aggregating
the runs of the sorted array, and the messages are concatenated to one training text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and of other common chat templates.
START, SEPARATOR, CONTINUE, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>"
FOREIGN = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

# What follows the first character of a control string.
_RESTS = "|".join(
    text[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]")
    for text in (START, SEPARATOR, CONTINUE, END, *FOREIGN)
)
ESCAPE_PATTERN = rf"([<\[])(\\*)({_RESTS})"
UNESCAPE_PATTERN = rf"([<\[])\\(\\*)({_RESTS})"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every (already escaped) control string."""
    return F.regexp_replace(text, ESCAPE_PATTERN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, UNESCAPE_PATTERN, "$1$2$3")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def _merge(turns: Column) -> Column:
    """Messages (role, parts) of sorted turns: one per run of neighbours with one role.

    The places where runs begin are filtered out first and each run is cut out of the turns, so the work grows with
    the number of turns; an aggregation that appends to its list would copy the list at every turn.
    """

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])

    def message(starts: Column, start: Column, i: Column) -> Column:
        size = F.coalesce(F.get(starts, i + 1), F.size(turns)) - start
        texts = F.transform(F.slice(turns, start + 1, size), lambda turn: turn["text"])
        return F.struct(F.get(turns, start)["role"].alias("role"), texts.alias("parts"))

    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), begins)
    return _bound(starts, lambda found: F.transform(found, lambda start, i: message(found, start, i)))


def _pieces(message: Column) -> Column:
    """The message as (text, loss) pieces: control strings outside, an assistant's texts inside the loss."""
    loss = message["role"] == "assistant"

    def piece(text: Column, inside: Column) -> Column:
        return F.struct(text.alias("text"), inside.alias("loss"))

    head = F.concat(F.lit(START), escape(message["role"]), F.lit(SEPARATOR))
    parts = F.transform(
        message["parts"],
        lambda text, i: F.array(
            piece(F.when(i == 0, head).otherwise(F.lit(CONTINUE)), F.lit(False)), piece(escape(text), loss)
        ),
    )
    return F.concat(F.flatten(parts), F.array(piece(F.lit(END), F.lit(False))))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, messages, pieces, formatted.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. ``messages`` are the merged
    turns (role, parts), ``pieces`` the text in (text, loss) pieces, whose concatenation is ``formatted``:
    the pieces marked ``loss`` are the loss mask. Turns are sorted by turn, ties by role and text; a
    null turn comes first. Null role or text is empty. Repeated rows are repeated turns. A row without conv_id
    belongs to no conversation: it is formatted alone, with a null conv_id. An empty table gives no rows.
    One conversation is one row, so it must fit a string (2 GB).
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = conversations.select("conv_id", turn.alias("turn"))
    together = (
        rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    alone = rows.where("conv_id IS NULL").select("conv_id", F.array("turn").alias("turns"))
    messages = _merge(F.col("turns"))
    pieces = F.flatten(F.transform("messages", _pieces))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return (
        together.unionByName(alone)
        .select("conv_id", messages.alias("messages"))
        .select("conv_id", "messages", pieces.alias("pieces"))
        .select("conv_id", "messages", "pieces", text.alias("formatted"))
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, merged ones apart again."""

    def quoted(*texts: str) -> str:
        return "|".join(text.replace("|", r"\|") for text in texts)

    def turns(message: Column) -> Column:
        fields = F.split(message, quoted(SEPARATOR, CONTINUE, END))
        return F.transform(
            F.slice(fields, F.lit(2), F.size(fields) - 2),
            lambda text: F.struct(unescape(fields[0]).alias("role"), unescape(text).alias("text")),
        )

    messages = F.split(formatted, quoted(START))
    return F.flatten(F.transform(F.slice(messages, F.lit(2), F.size(messages) - 1), turns))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    inside = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(inside, lambda p: unescape(p["text"])), "")
