"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

A log holds one row per event: conv_id, seq, turn, kind, role, text. Kinds:

* ``message``: opens a turn; its text starts the turn's current version
* ``delta``: appends its text to the current version (a streamed piece)
* ``edit``: replaces the current version's text
* ``regenerate``: starts a new version; every later turn begun before it is dropped,
  with what edits and deltas come later; a turn begins with its last ``message`` (with
  its first event, if it has none), so a dropped turn that is sent anew stays

Defined cases: null text counts as empty, null kind as ``message``, a null role
leaves the turn's role as it was (empty if it never had one). An event delivered
twice (same conv_id, turn, seq, kind, role and text) counts once; different
events with one seq apply in the order kind, role, text. Null conv_id rows form
one conversation. An empty log gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column, newline: bool = False) -> Column:
    """Reversible: afterwards ``<|`` cannot occur, nor (if asked) a line break."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("<|"), F.lit("\\l|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if newline else out


def unescape(text: Column, newline: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if newline else text
    out = F.replace(out, F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def turns_to_log(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a log: each row opens a turn and streams its text.

    Rows with equal turns, repeated rows included, stay separate turns in the
    order role, text.
    """
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.row_number().over(in_order).cast("long").alias("turn"), "role", "text")
    opened = F.struct((F.col("turn") * 2).alias("seq"), F.lit("message").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.lit("").alias("text"))
    streamed = F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", F.explode(F.array(opened, streamed)).alias("e")).select("conv_id", "turn", "e.*")


def fold_log(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log; one shuffle, on conv_id."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    by_turn = (
        log.repartition("conv_id")
        .groupBy("conv_id", "turn")
        .agg(F.array_distinct(F.sort_array(F.collect_list(event))).alias("log"))
        .withColumn("reset", F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i))), F.lit(0)))
        .select(
            "conv_id",
            "turn",
            F.coalesce(F.get(F.reverse(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())), F.lit(0)), F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice("log", F.col("reset") + 1, F.size("log")), lambda e: e["text"]), "").alias("text"),
            F.coalesce(F.array_max(F.transform("log", lambda e: F.when(e["kind"] == "message", e["seq"]))), F.get("log", F.lit(0))["seq"]).alias("begun"),
            F.array_max(F.transform("log", lambda e: F.when(e["kind"] == "regenerate", e["seq"]))).alias("regenerated"),
        )
    )
    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    cut = by_turn.withColumn("cut", F.max("regenerated").over(earlier))
    return cut.where(F.col("cut").isNull() | (F.col("begun") > F.col("cut"))).select("conv_id", "turn", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: the formatted text and the spans that mask it.

    spans has (head, body, loss) for each turn: ``formatted`` is, turn by turn, so many code
    points of template, so many of text, and the end mark. loss marks assistant texts.
    """
    turn = F.struct(
        "turn",
        F.concat(F.lit(START), escape(F.col("role"), newline=True), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == ASSISTANT).alias("loss"),
    )
    span = lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["loss"].alias("loss"))
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), F.transform("turns", span).alias("spans"))
    )


def format_chats(log: DataFrame) -> DataFrame:
    return render(fold_log(log))


def _blocks(formatted: Column) -> Column:
    """What follows each start mark; one cut through the text, so places are then counted within a turn."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation."""
    head = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(
        _blocks(formatted),
        lambda b: F.struct(
            unescape(head(b), newline=True).alias("role"),
            unescape(F.substring(b, F.length(head(b)) + 2, F.length(b) - F.length(head(b)) - 1 - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text of ``formatted`` under the loss mask, unescaped."""
    masked = lambda b, s: F.when(s["loss"], unescape(F.substring(b, s["head"] - len(START) + 1, s["body"])))
    return F.array_join(F.zip_with(_blocks(formatted), spans, masked), "")
