"""Chat formatting with Spark expressions only.

A conversation becomes ``<turn:ROLE>TEXT</turn>`` one after the other. Adjacent turns of
one role share a block; ``<+>`` stands between their texts. ``\\``, ``<`` and ``>`` inside
roles and texts are written ``\\b``, ``\\l`` and ``\\g``, so a plain ``<`` always begins a
control string, whatever a text says, and all of it can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bound, running_sums

OPEN, SHUT, NEXT = "<turn:", "</turn>", "<+>"
# Characters of the pieces in which a formatted conversation is read back.
_PIECE = 4096


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _blocks(turns: str, starts: str) -> Column:
    """Blocks (role, texts): the turns from each start up to the next."""

    def block(start: Column, nth: Column) -> Column:
        after = F.coalesce(F.get(starts, nth + 1), F.size(turns))
        texts = F.transform(F.slice(turns, start + 1, after - start), lambda t: t["text"])
        return F.struct(F.get(turns, start)["role"].alias("role"), texts.alias("texts"))

    return F.transform(starts, block)


def format_conversations(
    turns: DataFrame, loss_role: str = "assistant",
    id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """(id, formatted, loss_spans): one row per conversation.

    ``loss_spans`` is an array of (start, length) in characters of ``formatted``: every
    text of ``loss_role``, in order. Turns are sorted by (turn, role, text), nulls
    first; equal rows stay as often as they come. A null text or role is an empty one; a
    null id is a conversation of its own kind; an empty table gives an empty table;
    other columns are ignored. A conversation is one value and so is built in one place;
    rows are shuffled once, by id.
    """
    rows = turns.select(
        turns[id_column].alias("i"),
        F.struct(
            turns[turn_column].alias("turn"),
            escape(F.coalesce(turns[role_column], F.lit(""))).alias("role"),
            escape(F.coalesce(turns[text_column], F.lit(""))).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("i").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def begins(turn: Column, nth: Column) -> Column:
        return (nth == 0) | (turn["role"] != F.get("ts", nth - 1)["role"])

    # One select per step: an expression inside a lambda is worked out for every element.
    places = F.filter(F.transform("ts", lambda t, n: F.when(begins(t, n), n)), lambda n: n.isNotNull())
    told = sorted_turns.select("i", "ts", places.alias("starts")).select("i", _blocks("ts", "starts").alias("bs"), "ts")
    written = F.array_join(
        F.transform(
            "bs",
            lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(">"), F.array_join(b["texts"], NEXT), F.lit(SHUT)),
        ),
        "",
    )

    # Where every text ends: what stands before a turn's text, and the text.
    def length(turn: Column, nth: Column) -> Column:
        head = F.when(nth == 0, 0).otherwise(len(SHUT)) + F.length(turn["role"]) + len(OPEN) + 1
        return F.when(begins(turn, nth), head).otherwise(len(NEXT)) + F.length(turn["text"])

    ends = bound(F.transform("ts", length), running_sums)
    spans = F.zip_with(
        "ts", ends,
        lambda t, end: F.when(
            t["role"] == escape(F.lit(loss_role)),
            F.struct((end - F.length(t["text"])).alias("start"), F.length(t["text"]).alias("length")),
        ),
    )
    return told.select(F.col("i").alias(id_column), written.alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they went in."""
    parts = F.split(formatted, OPEN, -1)
    blocks = F.slice(parts, 2, F.size(parts))

    def of_block(block: Column) -> Column:
        role = F.substring_index(block, ">", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(SHUT))
        return F.transform(
            F.split(body, r"<\+>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, of_block))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""

    def cut(pieces: Column) -> Column:
        def text(span: Column) -> Column:
            first = F.floor(span["start"] / _PIECE).cast("int")
            last = F.floor((span["start"] + span["length"]) / _PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return unescape(F.substring(held, span["start"] - first * _PIECE + 1, span["length"]))

        return F.array_join(F.transform(spans, text), "")

    # A place in a long string is found by counting from its begin: short pieces make that quick.
    return bound(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), cut)
