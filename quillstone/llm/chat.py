"""Collapse of conversation snapshots, then rendering, in Spark's own expressions only.

Each turn's prefix is identified by two sums of hashes of (rank, role, text), of 40 bits a turn and with seeds of their
own. Such sums can be made block by block, so a conversation with very many turns is spread over tasks. A conversation
whose whole is a proper prefix of another one is a snapshot and goes (anti-join on rank and prefix hash); of equal
conversations the smallest id stays. The rest is rendered in parts of at most BLOCK turns.

Defined cases: turns are ordered by turn (nulls first), role and text, and a repeated row is a turn of its own; turns of
one conversation with the same number, or without one, are ordered by one task; a null role is `unknown`, a null text is
empty; rows without a conversation id are ignored, as are other columns, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import col, shared_table

BLOCK = 256
MASK = (1 << 40) - 1


def ranked(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """c, b (block of BLOCK turn numbers), k (rank from 1), role, text and the prefix hashes h1 and h2."""
    rows = conversations.select(col(conv_id).alias("c"), col(turn).alias("t"), F.coalesce(col(role), F.lit("unknown")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")).where("c is not null")
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("t") / BLOCK), F.lit(-(1 << 40))).cast("long"))
    inside = Window.partitionBy("c", "b").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("r", F.row_number().over(inside))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("c", "b").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = rows.join(counts, ["c", "b"]).withColumn("k", F.col("first") + F.col("r"))
    # 40 bits a turn, so that sums of millions of turns stay within 64
    for name, seed in (("h1", 1), ("h2", 2)):
        one = F.xxhash64(F.lit(seed), "k", "role", "text").bitwiseAND(F.lit(MASK))
        rows = rows.withColumn(f"{name}_in", F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("c", "b").agg(*(F.max(f"{h}_in").alias(h) for h in ("h1", "h2")))
    ends = ends.select("c", "b", *(F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}_first") for h in ("h1", "h2")))
    return rows.join(ends, ["c", "b"]).select("c", "b", "k", "role", "text", *((F.col(f"{h}_in") + F.col(f"{h}_first")).alias(h) for h in ("h1", "h2")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """c of the conversations that stay, with n_turns and n_same (how many equal ones there are)."""
    last = prefixes.groupBy("c").agg(F.max(F.struct("k", "h1", "h2")).alias("e")).select("c", "e.*")
    once = last.groupBy("k", "h1", "h2").agg(F.min("c").alias("c"), F.count("*").alias("n_same"))
    inner = prefixes.join(last.select("c", F.col("k").alias("n")), "c").where("k < n").select("k", "h1", "h2").distinct()
    return once.join(inner, ["k", "h1", "h2"], "left_anti").select("c", F.col("k").alias("n_turns"), "n_same")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def render(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, part, n_turns, n_same and text of every part of the maximal conversations."""
    rows = shared_table(ranked(conversations, conv_id, turn, role, text), "turns")
    kept = maximal(rows.select("c", "k", "h1", "h2"))
    shown = rows.join(kept, "c").withColumn("part", F.floor((F.col("k") - 1) / BLOCK).cast("long"))
    parts = shown.groupBy("c", "part", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("k", turn_text(F.col("role"), F.col("text")).alias("x")))).alias("a"))
    return parts.select(F.col("c").alias("conv_id"), "part", "n_turns", "n_same", F.array_join(F.transform("a", lambda x: x["x"]), "").alias("text"))
