"""Chat formatting from an event log.

Events of a conversation are ordered by their sequence number. A ``message`` starts the
next message, a ``delta`` appends to one, an ``edit`` or a ``regenerate`` replaces what it
holds so far. The final messages are rendered with a template whose control strings are
escaped inside texts, together with the spans that count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditpath.llm.common import sha256_hex

# Template: <s>, then for every message <|role|>, a line break, the text, </s> and a line break.
BEGIN, END = "<s>", "</s>\n"
LOSS_ROLE = "assistant"
# A backslash goes between the first character of a control string and the rest, after any that are there.
_TAIL = r"(?=\||/?s>|/?INST\])"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _TAIL, r"([<\[])(\\*)\\" + _TAIL


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A table with one finished message per row (conv_id, turn, role, text) as a log."""
    return turns.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("long").alias("target"),
        "role",
        "text",
    )


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages of each conversation after all its events.

    ``events`` has conv_id, seq, kind, target, role and text. ``message`` starts the next
    message of its conversation; ``delta`` appends its text, ``edit`` and ``regenerate``
    replace the text, of message number ``target`` or, without one, of the latest message.
    Ties in seq are ordered by kind (message first), target, role and text, so repeated
    ``message`` rows are messages of their own. Events before any message build message 0.
    A NULL text is empty, a NULL kind is a ``message``, a NULL conv_id is one conversation;
    the role is the first that is not NULL, or empty. Further columns are ignored.
    """
    kind = F.coalesce("kind", F.lit("message"))
    starts = kind == "message"
    order = Window.partitionBy("conv_id").orderBy("seq", ~starts, kind, "target", "role", "text")
    numbered = events.select(
        "conv_id",
        F.row_number().over(order).alias("at"),
        F.coalesce(
            F.when(~starts, F.col("target")),
            F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        ).alias("message"),
        (kind == "delta").alias("adds"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = numbered.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("at", "adds", "role", "text"))).alias("log")
    )
    reset = F.array_max(F.transform(F.filter("log", lambda e: ~e["adds"]), lambda e: e["at"]))
    grouped = grouped.withColumn("_from", F.coalesce(reset, F.lit(0)))
    live = F.filter("log", lambda e: e["at"] >= F.col("_from"))
    named = F.filter("log", lambda e: e["role"].isNotNull())
    return grouped.select(
        "conv_id",
        "message",
        F.coalesce(F.get(named, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text of each conversation and where the loss counts.

    loss_spans holds, in order, the first code point (from 0) and the end of the escaped
    text of each message of role ``assistant``.
    """
    header = F.concat(F.lit("<|"), F.url_encode("role"), F.lit("|>\n"))
    body = escaped(F.col("text"))
    parts = messages.select("conv_id", "message", "role", header.alias("_header"), body.alias("_body"))
    turn = F.concat("_header", "_body", F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_turn", turn)
    parts = parts.withColumn("_end", F.sum(F.length("_turn")).over(order) + len(BEGIN) - len(END))
    loss = F.when(F.col("role") == LOSS_ROLE, F.struct((F.col("_end") - F.length("_body")).alias("start"), F.col("_end").alias("end")))
    grouped = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "_turn"))).alias("_turns"),
        F.sort_array(F.collect_list(loss)).alias("loss_spans"),
    )
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("_turns", lambda t: t["_turn"]), ""))
    return grouped.select("conv_id", text.alias("formatted"), "loss_spans")


def format_chats(events: DataFrame) -> DataFrame:
    """Reconstruct and render every conversation of an event log; see ``final_messages`` and ``rendered``."""
    return rendered(final_messages(events))


def read_turns(formatted: Column) -> Column:
    """The (role, text)s of a formatted conversation."""
    inner = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END)
    inner = F.slice(inner, 1, F.size(inner) - 1)
    pattern = r"(?s)^<\|([^|]*)\|>\n(.*)$"
    return F.transform(
        inner,
        lambda t: F.struct(
            F.url_decode(F.regexp_extract(t, pattern, 1)).alias("role"),
            unescaped(F.regexp_extract(t, pattern, 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    each = F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return F.array_join(each, "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the rendered text."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("_turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        sha256_hex(told).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("_loss")).alias("loss_sha256"),
        "formatted_chars",
    )
