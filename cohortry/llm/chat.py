"""Chat formatting from an event log: fold events into messages, render them with a template, read the result back.

DataFrame functions only. Fixed values of the template: a turn is START role newline text END newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"

#: kinds of events; any other kind, and null, counts as "message"
MESSAGE, DELTA, EDIT, AGAIN = "message", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    """No control string is left inside: a tilde becomes ~0, every "<|" ~1."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def escape_role(role: Column) -> Column:
    """As text, and line feeds, which end a role, become ~2."""
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("\n")), F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) from events (conv_id, seq, message, kind, role, text).

    Events of a conversation count in order of seq. A message or an edit sets a message's text, a regeneration sets it too (null
    text: empty) and takes back all later messages of the conversation that were last set before it; a delta is appended. The
    role is that of the first event with one. Null text is empty. Events with equal seq go by kind (message, edit, regenerate,
    delta), then by text. Null conv_id or message is a value of its own; null seq comes first.
    """
    kind = F.when(F.col("kind").isin(DELTA, EDIT, AGAIN), F.col("kind")).otherwise(MESSAGE)
    turn = F.when(kind == MESSAGE, 0).when(kind == EDIT, 1).when(kind == AGAIN, 2).otherwise(3)
    said = events.select("conv_id", "message", "seq", kind.alias("kind"), turn.alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct(F.col("seq").isNotNull().alias("known"), F.col("seq"), F.col("turn"), F.col("text"))
    setting = F.when(F.col("kind") != DELTA, order)
    of_message = Window.partitionBy("conv_id", "message")
    live = said.withColumn("order", order).withColumn("set", F.max(setting).over(of_message))
    folded = live.groupBy("conv_id", "message").agg(
        F.first("set").alias("set"),
        F.max(F.when(F.col("kind") == AGAIN, F.col("order"))).alias("again"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("order", "role"))).alias("role"),
        F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.when(F.col("set").isNull() | (F.col("order") >= F.col("set")), F.struct("order", "text")))),
            lambda e: e["text"],
        )).alias("text"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("taken_back", F.max("again").over(before))
    return folded.where("taken_back is null or (set is not null and set > taken_back)").select(
        "conv_id", "message", F.col("role.role").alias("role"), "text"
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and spans (start and length in code points of every trained text, from 1)."""
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body, tail = escape(F.coalesce("text", F.lit(""))), F.lit(END + "\n")
    turns = messages.select("conv_id", "message", F.struct(
        F.concat(head, body, tail).alias("piece"), (F.col("role") == TRAINED).alias("trained"),
        F.length(head).alias("head"), F.length(body).alias("body"),
    ).alias("turn"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "turn"))).alias("turns"))
    start = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["turn"]["piece"])).alias("at"),
            F.when(
                F.coalesce(t["turn"]["trained"], F.lit(False)),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["turn"]["head"]).alias("start"), t["turn"]["body"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return listed.select(
        "conv_id", F.concat_ws("", F.transform("turns", lambda t: t["turn"]["piece"])).alias("formatted"), start.alias("spans")
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) that `render` wrote into the string."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: _parsed(F.substr(p, F.lit(len(START) + 1))))


def _parsed(piece: Column) -> Column:
    cut = F.locate("\n", piece)
    return F.struct(
        unescape(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(piece, cut + 1)).alias("text")
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The trained texts as they were, one after another."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))))


def as_events(conversations: DataFrame) -> DataFrame:
    """Whole messages as events: rows (conv_id, turn, role, text) in order of turn; equal turns go by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), F.row_number().over(order).cast("long").alias("message"),
        F.lit(MESSAGE).alias("kind"), "role", "text",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, formatted, spans.

    Null text is empty, null roles are empty roles, null turns come first and a null conv_id is a conversation. Repeated rows
    are turns of their own. A conversation is one string in the end, so it has to fit into a row; nothing else is gathered.
    Other columns aren't read. An empty table gives an empty result.
    """
    typed = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    return render(fold_events(as_events(typed)))


def digest(formatted: DataFrame) -> DataFrame:
    """What was formatted, read back from it: turns, what is trained on, and sizes."""
    back = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("spans")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
