"""Chat formatting: collapse of cumulative snapshots, DataFrame functions only.

A logging system that stores a conversation after every turn leaves records
that are prefixes of later ones.  A rolling hash of the turns, a running sum of
hashes salted with the turn's rank, names each prefix; conversations whose
whole hash is a proper prefix of another are dropped by an anti-join, of equal
ones the smallest id stays, and the maximal ones are rendered.

Defined results: turns are ordered by turn, then role, then text, nulls first;
null roles and texts count as empty; turns without a conversation id are left
out; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the chat template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, n (its rank), and three sums that identify the turns up to it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ranked = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n", F.row_number().over(order).cast("long"))
    first = F.xxhash64("n", "role", "text")
    second = F.xxhash64("text", "n", "role", F.lit(1))
    hashed = ranked.select(
        "conv_id",
        "n",
        F.shiftrightunsigned(first, 32).alias("a"),
        first.bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"),
        F.shiftrightunsigned(second, 32).alias("c"),
    )
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "n", *(F.sum(x).over(so_far).alias(x) for x in "abc"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each conversation that is no proper prefix of another; of equal ones the least."""
    prefixes = turn_prefixes(turns)
    last = prefixes.withColumn("n_turns", F.max("n").over(Window.partitionBy("conv_id")))
    key = ["n", "a", "b", "c"]
    whole = last.where(F.col("n") == F.col("n_turns")).groupBy(key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = last.where(F.col("n") < F.col("n_turns")).select(key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat, the rendered text, of each maximal conversation."""
    chosen = maximal(turns)
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = said.join(chosen, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    one = lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END + "\n"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", one), "").alias("chat"))
