"""Chat formatting after cumulative snapshots are collapsed.

Logged conversations often hold a growing conversation again and again: turns 1-2, then 1-4, then 1-6. Every
turn's prefix hash is the exclusive-or of position-dependent hashes of the turns up to it, so it
rolls along the turns. A conversation whose whole hash is a prefix hash of a longer one, or that equals one with a smaller id, is
removed by anti-joins; what is maximal is rendered. Only DataFrame functions are used.

Turns are numbered in two steps, within blocks of ``BLOCK`` turn numbers and then over the blocks' sums, so
that a conversation of any length is dealt over many tasks up to the rendering.

Defined results: turns go by (turn, role, text), nulls first; repeated rows count once; a null role or text is
an empty one when rendered, but differs from it when compared; null ids are one conversation; an empty
table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import saved

BLOCK = 1024
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _turn_hash(salt: int) -> Column:
    """Differs for null and empty, and by position."""
    return F.xxhash64(F.lit(salt), "k", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefixes(conversations: DataFrame) -> DataFrame:
    """The distinct turns with k (their place, from 1), n (turns of the conversation) and h1, h2 (the prefix's hash)."""
    turns = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).drop("copies")
    blocked = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    sums = blocked.groupBy("conv_id", "block").agg(F.count("*").alias("m"))
    of_conv = Window.partitionBy("conv_id")
    earlier = of_conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset"), F.sum("m").over(of_conv).alias("n")
    )
    on = F.expr("conv_id <=> _c and block <=> _b")
    placed = blocked.withColumn("k", F.row_number().over(inner)).join(offsets, on).drop("_c", "_b").withColumn("k", F.col("k") + F.col("offset")).drop("offset")
    marked = placed.withColumns({"t1": _turn_hash(1), "t2": _turn_hash(2)})
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({"h1": F.bit_xor("t1").over(running), "h2": F.bit_xor("t2").over(running)})
    blocks = marked.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = blocks.select(
        F.col("conv_id").alias("_c"),
        F.col("block").alias("_b"),
        F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("o1"),
        F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("o2"),
    )
    return (
        local.join(before, on)
        .withColumns({"h1": F.col("h1").bitwiseXOR(F.col("o1")), "h2": F.col("h2").bitwiseXOR(F.col("o2"))})
        .drop("_c", "_b", "o1", "o2", "t1", "t2")
    )


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n of the conversations that no longer one begins with; of equal ones the smallest id."""
    whole = hashed.where("k = n").select("conv_id", "n", "h1", "h2")
    first = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.where("k < n").groupBy(F.col("k").alias("n"), "h1", "h2").agg(F.count("*").alias("copies"))
    return first.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of each maximal conversation."""
    hashed = saved(prefixes(conversations.select("conv_id", "turn", "role", "text")), "turns")
    kept = saved(maximal(hashed), "maximal").select(F.col("conv_id").alias("_c"), F.col("n").alias("n_turns"))
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit("\n" + END))
    lines = hashed.join(kept, F.expr("conv_id <=> _c")).select("conv_id", "n_turns", "k", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("conv_id", "n_turns").agg(joined.alias("text"))
