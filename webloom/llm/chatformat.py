"""Chat formatting after collapsing cumulative snapshots, with DataFrame operations only.

Chat logs often hold a conversation again after every turn. Each conversation gets rolling hashes of its turn
prefixes: running sums of two hashes of (position, role, text). One whose whole hash is the hash of a proper prefix of
another is a snapshot and goes; of conversations with equal turns the smallest id stays. Prefixes and whole
conversations are reduced to distinct hashes before they meet in an anti-join, so a common first turn or a
conversation logged over and over is one row there.

Defined results: turns are ordered by turn, role and text, nulls first; fully equal rows of a conversation count once;
a null role is rendered as `unknown`, a null text as empty, yet both differ from those values in comparisons; rows
without a conv_id belong to no conversation; an empty table gives an empty result; extra columns are ignored. A
conversation is rendered to one string, so its turns come together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    """40 bits, so that sums of up to 2**23 turns fit."""
    parts = [F.lit(seed), F.col("step"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.shiftrightunsigned(F.xxhash64(*parts), 24)


def render(turns: Column) -> Column:
    """One string of an array of (step, role, text); markers inside texts are broken up."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    one = lambda t: F.concat(F.lit(OPEN), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations of (conv_id, turn, role, text)."""
    # Dealt by conversation at once, texts move one time for everything that follows.
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL").repartition("conv_id").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    steps = rows.withColumn("step", F.row_number().over(order))
    until = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    hashed = steps.select("conv_id", "step", _hash(1).alias("a"), _hash(2).alias("b"))
    rolled = hashed.select(
        "conv_id",
        "step",
        F.sum("a").over(until).alias("a"),
        F.sum("b").over(until).alias("b"),
        F.lead("step").over(Window.partitionBy("conv_id").orderBy("step")).isNull().alias("whole"),
    )
    wholes = rolled.filter("whole").groupBy("step", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rolled.filter("NOT whole").select("step", "a", "b").distinct()
    kept = wholes.join(prefixes, ["step", "a", "b"], "left_anti").select("conv_id", "n_copies")
    turns = steps.join(kept, "conv_id").groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_list(F.struct("step", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))
