"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered with that speaker as the
assistant and all others as users that carry their names; ``system`` turns stay system
turns and aren't rotated.  The mask of a rendering is the list of code-point ranges to
learn from: the speaker's own text and its end mark.

A rendering comes in segments of ``SEGMENT`` turn numbers, so that a dialogue of any
length is never gathered in one place: one row for each (conversation, perspective,
segment), and the text of a dialogue is that of its segments in order.  Shorter
dialogues are one row.

Defined results: a null text is an empty one; a null role is a participant named
``unknown``; a null turn comes in a segment of its own, before all others; equal turns
are ordered by role and text, and repeated rows are rendered as often as they occur;
a conversation of system turns only has no participant and no row; rows with a null
conv_id are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEGMENT = 256
START, END, UNNAMED = "<|im_start|>", "<|im_end|>\n", "unknown"


def _piece(turn: Column, perspective: Column) -> Column:
    """(head, body): what is shown before a turn's text, and the text with its end mark."""
    own = turn["role"] == perspective
    head = F.concat(F.lit(START), F.when(turn["role"] == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), turn["role"])), F.lit("\n"))
    return F.struct(head.alias("head"), F.concat(turn["text"], F.lit(END)).alias("body"), own.alias("own"))


def rotate(turns: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """conv_id, perspective, segment, n_turns, n_own, text, mask of every participant's rendering of (conv_id, turn, role, text).

    Without ``segment`` every rendering is one row of segment 0, whatever its length.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("segment", F.lit(0).cast("long") if segment is None else F.floor(F.col("turn") / segment).cast("long"))
    people = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    dealt = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = dealt.alias("d").join(people.alias("p"), F.col("d.conv_id").eqNullSafe(F.col("p.conv_id"))).select("d.conv_id", "perspective", "segment", "turns")
    both = both.withColumn("pieces", F.transform("turns", lambda t: _piece(t, F.col("perspective"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("mask"))

    def add(acc: Column, p: Column) -> Column:
        low = acc["at"] + F.length(p["head"])
        high = low + F.length(p["body"])
        span = F.struct(low.cast("long").alias("start"), high.cast("long").alias("end"))
        return F.struct(high.cast("long").alias("at"), F.when(p["own"], F.array_append(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return both.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("pieces", start, add)["mask"].alias("mask"),
    )


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every conversation; the mask as text (``start-end`` joined by commas) beside its size."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", spans)
