"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged
into a message, and the message is written as

    <s> [ROLE] role [/ROLE] text ([SEP] text)* </s>

without the blanks, all messages after a single ``<s>``. Inside roles and texts a control string gets
one more backslash behind its first character, so a control string without one is always a mark of
the template and reading back removes exactly one. A conversation becomes one row, so the length of
the longest conversation bounds what one task holds; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, ROLE, ROLE_END, SEP = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[SEP]"
# What is escaped: the marks above and those of common instruction templates.
_TAIL = r"(/?(?:s>|ROLE\]|SEP\]|INST\]))"
LOSS_ROLE = "assistant"
#: Where a head, a text or a mark ends and another begins.
_BORDER = r"(?<=<s>|</s>|\[/ROLE\]|\[SEP\])|(?=</s>|\[ROLE\]|\[SEP\])"


def escape(text: Column) -> Column:
    """A text in which no control string is left; ``unescape`` gives the text again."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def _with_messages(grouped: DataFrame) -> DataFrame:
    """``grouped(conv_id, turns)`` with runs of adjacent turns of one role as ``messages: array<struct<role, texts>>``."""
    n = F.size("turns")
    role = lambda i: F.get("turns", i)["role"]
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i - 1) != role(i)))
    # A column of its own: inside the expression below it would be found anew for every message.
    begun = grouped.select("conv_id", "turns", first.alias("starts"))

    def message(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), n)
        run = F.slice("turns", start + 1, stop - start)
        return F.struct(role(start).alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

    return begun.select("conv_id", F.transform("starts", message).alias("messages"))


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, mask``.

    ``mask`` has the runs of ``formatted`` in order as ``array<struct<n_chars, loss>>`` in code points;
    a run is under the loss if it is one text of ``loss_role``. Turns sort by turn, role, text; null
    roles and texts count as empty, a null turn comes first, the null conv_id is a conversation of its
    own, rows that repeat stay as turns, texts may have any length, and an empty table gives no row. Extra
    columns are not read. Work grows with the text and the number of turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = _with_messages(grouped)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(m: Column) -> Column:
        head = F.concat(F.lit(ROLE), escape(m["role"]), F.lit(ROLE_END))
        under = m["role"] == F.lit(loss_role)
        texts = F.transform(
            m["texts"],
            lambda t, i: F.concat(F.when(i > 0, F.array(piece(F.lit(SEP), no))).otherwise(F.slice(F.array(piece(F.lit(SEP), no)), 1, 0)), F.array(piece(escape(t), under))),
        )
        return F.concat(F.array(piece(head, no)), F.flatten(texts), F.array(piece(F.lit(END), no)))

    parts = F.concat(F.array(piece(F.lit(BEGIN), no)), F.flatten(F.transform("messages", pieces)))
    built = merged.select("conv_id", parts.alias("parts"))
    runs = F.transform("parts", lambda p: F.struct(F.length(p["text"]).cast("long").alias("n_chars"), p["loss"].alias("loss")))
    return built.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), runs.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    body = F.substring(formatted, len(BEGIN) + 1, 2147483647)
    blocks = F.split(body, END)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        halves = F.split(block, r"\[/ROLE\]", 2)
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(ROLE) + 1, 2147483647))
        return F.transform(F.split(F.get(halves, F.lit(1)), r"\[SEP\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order. A mask that doesn't fit the text is an error.

    Texts hold no control string, so the places where runs of the mask meet are those at the marks.
    """
    pieces = F.filter(F.split(formatted, _BORDER), lambda p: p != "")
    runs = F.filter(mask, lambda run: run["n_chars"] > 0)

    def under(piece: Column, run: Column) -> Column:
        fits = F.length(piece) == run["n_chars"]
        return F.when(fits, F.when(run["loss"], unescape(piece)).otherwise(F.lit(""))).otherwise(F.raise_error(F.lit("the mask doesn't fit the text")))

    return F.array_join(F.zip_with(pieces, runs, under), "")
