"""Chat formatting: conversations rebuilt from event logs, then rendered with a loss mask.

An event is (conv_id, seq, message, kind, role, text). Events of a conversation are put in order and folded:

* ``message`` opens a message with its role and text,
* ``delta`` appends its text (a delta without an open message opens one),
* ``edit`` puts its text in the place of all text so far,
* ``regenerate`` throws away the text so far and starts again with its own, mostly empty, text.

The fold is linear in the events: a message's events are a slice, its last replacement is found in the slice, and the
texts from there on are joined. Events are gathered once a conversation, with partial gathering ahead of the shuffle.
A conversation is one row of the output with one string in it, so its events are bounded by that row (2 GB).

A rendered message is ``<turn>role<text>text</turn>`` and a newline. Inside roles and texts a backslash is doubled
and one is put behind the ``<`` of a mark, so marks never occur there and taking the backslashes out restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
MARKS = (TURN, TEXT, END)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark.replace("<", "<\\", 1)))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_events(turns: DataFrame) -> DataFrame:
    """Events of a table of whole turns: each row opens a message."""
    turn = F.col("turn")
    return pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", turn.alias("seq"), turn.alias("message"), F.lit("message").alias("kind"), "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, messages), messages an array of (role, text) in the order in which they were opened.

    NULL roles and texts are empty, a NULL conversation is one of its own, NULL sequence numbers come first. Events
    that share a sequence number are ordered by kind (opening first), role and text; repeated events count each.
    """
    rank = F.when(F.col("kind") == "message", 0).otherwise(1)
    event = F.struct(
        F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), rank.alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "kind",
    )
    logs = pick(events, "conv_id", "seq", "message", "kind", "role", "text").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(event)).alias("log")
    )

    def whole(part: Column) -> Column:
        """One message of its events."""
        starts = F.filter(
            F.sequence(F.lit(1), F.size(part)), lambda i: part[i - 1]["kind"].isin("message", "edit", "regenerate")
        )
        last = F.greatest(F.coalesce(F.array_max(starts), F.lit(1)), F.lit(1))
        kept = F.slice(part, last, F.size(part) - last + 1)
        return F.struct(
            part[0]["seq"].alias("seq"), part[0]["message"].alias("message"), part[0]["role"].alias("role"),
            F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
        )

    def messages(log: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(1), F.size(log)),
            lambda i: (i == 1) | (log[i - 1]["kind"] == "message")
            | ~log[i - 1]["message"].eqNullSafe(log[F.greatest(i - 2, F.lit(0))]["message"]),
        )
        return let(opens, lambda at: F.transform(
            F.sequence(F.lit(1), F.size(at)),
            lambda k: let(F.slice(
                log, at[k - 1], F.coalesce(F.get(at, k), F.size(log) + 1) - at[k - 1]
            ), whole),
        ))

    return logs.select("conv_id", let(F.col("log"), messages).alias("messages")).select(
        "conv_id",
        F.transform(
            F.sort_array("messages"), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))
        ).alias("messages"),
    )


def render(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) of (conv_id, messages).

    loss holds the spans (turn, start, length) under the loss mask: code points of one rendered turn, from zero.
    They cover the texts of the trained roles and nothing else.
    """
    def block(m: Column) -> Column:
        return F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), escape(m["text"]), F.lit(END + "\n"))

    def span(m: Column, i: Column) -> Column:
        head = F.length(escape(m["role"])) + len(TURN) + len(TEXT)
        return F.struct(i.alias("turn"), head.alias("start"), F.length(escape(m["text"])).alias("length"))

    spans = F.filter(
        F.transform("messages", lambda m, i: F.when(m["role"].isin(*trained), span(m, i))), lambda s: s.isNotNull()
    )
    return conversations.select(
        "conv_id", F.array_join(F.transform("messages", block), "").alias("formatted"), spans.alias("loss")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts) read back from (conv_id, formatted, loss)."""
    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(TURN) + 1))
        at = F.locate(TEXT, body)
        return F.struct(
            unescape(F.substr(body, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(body, at + len(TEXT))).alias("text"),
        )

    blocks = F.split(F.col("formatted"), F.lit(END + "\n"))
    return formatted.select(
        "conv_id", "formatted",
        let(blocks, lambda b: F.struct(
            F.transform(F.slice(b, 1, F.size(b) - 1), turn).alias("turns"),
            F.transform("loss", lambda s: unescape(
                F.substr(b[s["turn"]], s["start"] + 1, s["length"])
            )).alias("loss_texts"),
        )).alias("back"),
    ).select("conv_id", "formatted", "back.*")


def format_chats(events: DataFrame) -> DataFrame:
    """The formatted conversations of an event log, see :func:`fold` and :func:`render`."""
    return render(fold(events))
