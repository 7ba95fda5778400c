"""Chat formatting in budgeted, turn-aligned windows. DataFrame operations only.

Template. A turn is ``[INST role] text [/INST]</s>``. Control strings start with ``[INST``,
``[/INST``, ``<s>`` or ``</s>``. Inside roles and texts a backslash is put behind the opening
bracket of anything that reads as one (one more if there are some already), so a text can neither
open nor close a turn and ``unescape`` gives it back exactly. In roles ``%`` and ``]`` are percent-coded too.

Windows. Turn costs are words plus ``TURN_COST``. Prefix sums are made in two levels, inside blocks
of turn numbers and over block totals, so that one huge conversation is spread over many tasks.
The conversation's leading system turn starts every window and counts: with ``room`` for what it leaves of
the budget, history is at most a third of the room and ``step = (room - history) / 2``. A turn belongs to the window of the step in
which it starts; a turn longer than a step stands alone. So a window's own turns fit ``2 * step`` unless a
single turn is longer. A window repeats the turns before it that lie within ``history`` tokens, as far as its own turns leave room.
So a window costs more than the budget only where one turn and the system turn together do. Repeated turns are never targets: the loss mask
covers the texts of own assistant turns only, so each assistant text is a target exactly once.

Edge cases. Null texts and roles are empty. Rows without conv_id form one conversation. Equal turn
numbers are ordered by role, then text; repeated rows are kept as turns. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Fixed values of the template.
OPEN, BODY, CLOSE, END = "[INST ", "] ", " [/INST]", "</s>"
CONTROL = r"(?=/?INST|/?s>)"
TURN_COST = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + CONTROL, "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%")))


def with_prefix_sums(turns: DataFrame, block_turns: int) -> DataFrame:
    """Adds ``start``, the cost of all earlier turns of the conversation, and ``system``, its leading system turn if any."""
    block = F.floor(F.coalesce("turn", F.lit(-1)) / block_turns)
    turns = turns.withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    part = turns.withColumn("inside", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    along = Window.partitionBy("conv_id").orderBy("block")
    totals = (
        turns.groupBy("conv_id", "block")
        .agg(F.sum("cost").alias("total"), F.min(F.struct("turn", "role", "text")).alias("first"))
        .select(
            F.col("conv_id").alias("c"), F.col("block").alias("b"),
            F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
            F.first("first").over(along).alias("first"),
        )
        .withColumn("system", F.when(F.col("first.role") == "system", F.col("first.text")))
    )
    joined = part.join(totals, part.conv_id.eqNullSafe(totals.c) & (part.block == totals.b))
    return joined.select("conv_id", "turn", "role", "text", "cost", (F.col("ahead") + F.col("inside")).alias("start"), "system")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(BODY), escape(text), F.lit(CLOSE + END))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, block_turns: int = 256) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, n_repeated, loss`` (spans of code points, start and length)."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("cost", F.regexp_count("text", F.lit(WORD)) + TURN_COST)
    lead_cost = F.when(F.col("system").isNotNull(), F.regexp_count("system", F.lit(WORD)) + TURN_COST).otherwise(0)
    placed = with_prefix_sums(turns, block_turns).withColumn("room", budget - lead_cost)
    placed = placed.withColumn("reach", F.greatest(F.lit(0), F.least(F.lit(history), F.floor(F.col("room") / 3))))
    step = F.greatest(F.lit(1), F.floor((F.col("room") - F.col("reach")) / 2))
    own = F.floor(F.col("start") / step) * 2 + (F.col("cost") > step).cast("int")
    # A short turn may be history in the rest of its step and in the next one.
    seats = F.when(F.col("own") % 2 == 0, F.array("own", F.col("own") + 1, F.col("own") + 2)).otherwise(F.array("own"))
    members = placed.withColumn("own", own).withColumn("window", F.explode(seats)).select(
        "conv_id", "window", "system", "room", "reach", "cost", (F.col("window") == F.col("own")).alias("is_own"),
        F.struct("start", "turn", "role", "text").alias("t"),
    )
    windows = members.groupBy("conv_id", "window").agg(
        F.min(F.when(F.col("is_own"), F.col("t.start"))).alias("begin"),
        F.sort_array(F.collect_list(F.when(F.col("is_own"), F.col("t")))).alias("targets"),
        F.sort_array(F.collect_list(F.when(~F.col("is_own"), F.col("t")))).alias("earlier"),
        F.first("system").alias("system"), F.first("reach").alias("reach"),
        (F.first("room") - F.sum(F.when(F.col("is_own"), F.col("cost")))).alias("left"),
    ).where("begin is not null")
    since = F.col("begin") - F.greatest(F.lit(0), F.least("reach", "left"))
    kept = F.filter("earlier", lambda t: (t.start >= since) & (t.start > 0))
    # The turn at start 0 is the system turn where there is one; it is put in front in its own right.
    kept = F.when(F.col("system").isNotNull(), kept).otherwise(F.filter("earlier", lambda t: t.start >= since))
    lead = F.when(F.col("system").isNotNull() & (F.col("begin") > 0), F.array(turn_text(F.lit("system"), F.col("system")))).otherwise(F.array().cast("array<string>"))
    context = F.concat(lead, F.transform(kept, lambda t: turn_text(t.role, t.text)))
    shown = windows.select("conv_id", "window", context.alias("context"), F.transform("targets", lambda t: F.struct(
        turn_text(t.role, t.text).alias("shown"), (t.role == "assistant").alias("scored"),
        F.length(F.concat(F.lit(OPEN), escape_role(t.role), F.lit(BODY))).alias("head"))).alias("targets"))
    placed_turns = F.aggregate(
        "targets",
        F.struct(F.length(F.array_join("context", "")).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda s, t: F.struct(
            (s.at + F.length(t.shown)).alias("at"),
            F.when(t.scored, F.concat(s.loss, F.array(F.struct(
                (s.at + t["head"]).alias("start"), (F.length(t.shown) - t["head"] - len(CLOSE + END)).alias("length"))))).otherwise(s.loss).alias("loss"),
        ),
        lambda s: s.loss,
    )
    return shown.select(
        "conv_id", "window",
        F.array_join(F.concat("context", F.transform("targets", lambda t: t.shown)), "").alias("formatted"),
        F.size("context").alias("n_repeated"), placed_turns.alias("loss"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts are made of another template's control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads windows back: per window its own turns (role, text) and the texts under the loss mask, all unescaped."""
    pieces = F.split("formatted", END)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    turn = lambda p: F.struct(
        unescape_role(F.regexp_extract(p, r"^\[INST ([^\]]*)\] ", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(p, r"^\[INST [^\]]*\] ", ""), r" \[/INST\]\z", "")).alias("text"),
    )
    return windows.select(
        "conv_id", "window", F.transform(own, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring("formatted", s.start + 1, s.length))).alias("scored"),
        F.length("formatted").alias("formatted_chars"),
    )


def digest_conversations(windows: DataFrame) -> DataFrame:
    """Per conversation the digests of what its windows hold. A conversation's text must fit one row here, as its digest is sequential."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = read_windows(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("scored", "").alias("scored"), "formatted_chars")
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return (
        parts.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
             F.sort_array(F.collect_list(F.struct("window", "said", "scored"))).alias("parts"))
        .select(
            "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
            F.length(joined("scored")).cast("long").alias("loss_chars"), F.sha2(joined("scored"), 256).alias("loss_sha256"),
            F.col("formatted_chars").cast("long").alias("formatted_chars"),
        )
    )
