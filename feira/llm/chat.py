"""Chat formatting of the maximal conversations of a log.

A logger that stores a conversation after every turn leaves cumulative snapshots:
conversations whose turns are the beginning of a longer one. They are collapsed
before rendering.

1. Turns get their place in the conversation (by ``turn``, then role, then text).
   Each prefix of a conversation has a rolling hash: the running sums of the turns'
   hashes, each taken together with its place. Two hashes of 64 bits with their lengths
   identify a prefix.
2. An anti-join drops each conversation whose full hash is a shorter prefix of another
   one. Of conversations that are equal the smallest id stays.
3. The turns of those that stay are rendered.

Places and running sums are taken in two levels: within ranges of ``BLOCK`` turn numbers,
and over the ranges' totals. So a conversation that holds a third of all turns is many
groups. Equal prefixes, however frequent, are pre-aggregated before the join.

Defined cases: rows with a null conversation id are left out; a null turn number comes
before all others; null roles and texts differ from empty ones when compared and are
rendered as empty; repeated rows are turns of their own; an empty table gives an empty
result; other columns are ignored. All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import materialise

BLOCK = 256
SUMS = ("a_low", "a_high", "b_low", "b_high")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``block`` and ``place`` (from 1 within the conversation)."""
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("row", F.row_number().over(inner)).join(starts, ["conv_id", "block"]).withColumn("place", F.col("start") + F.col("row")).drop("start", "row")


def _prefixes(placed: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` and the rolling hash of the first ``place`` turns."""
    one = F.xxhash64(F.lit(1), F.col("place"), F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00")))
    two = F.xxhash64(F.coalesce("text", F.lit("\x01")), F.coalesce("role", F.lit("\x01")), F.col("place"), F.lit(2))
    hashed = placed.select("conv_id", "block", "place", one.alias("one"), two.alias("two"))
    # Halves of 32 bits, so that sums don't overflow.
    halves = hashed.select(
        "conv_id",
        "block",
        "place",
        F.col("one").bitwiseAND(0xFFFFFFFF).alias("a_low"),
        F.shiftright("one", 32).alias("a_high"),
        F.col("two").bitwiseAND(0xFFFFFFFF).alias("b_low"),
        F.shiftright("two", 32).alias("b_high"),
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = halves.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in SUMS))
    starts = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in SUMS))
    running = halves.select("conv_id", "block", "place", *(F.sum(c).over(inner).alias(c) for c in SUMS))
    return running.join(starts, ["conv_id", "block"]).select("conv_id", "place", *((F.col(c) + F.col(f"{c}_start")).alias(c) for c in SUMS))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that stay."""
    prefixes = materialise(_prefixes(_placed(turns)), "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = prefixes.join(lengths, "conv_id")
    key = ["place", *SUMS]
    full = marked.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    continued = marked.filter("place < n_turns").select(*key).distinct()
    return full.join(continued, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``place`` and ``rendered`` per turn of the maximal conversations.

    A conversation's training text is its rendered turns in order of ``place``. They stay rows of
    their own, as a conversation may be longer than a task's memory; see ``format_conversations``.
    """
    kept = maximal_conversations(turns)
    return _placed(turns).join(kept, "conv_id").select("conv_id", "n_turns", "place", render_turn(F.col("role"), F.col("text")).alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` per maximal conversation, for logs whose conversations fit a task's memory."""
    per_turn = format_turns(turns)
    joined = per_turn.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", "rendered"))).alias("turns"))
    return joined.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("rendered"))
