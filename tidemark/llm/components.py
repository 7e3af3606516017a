"""Connected components of a graph given as a table of edges, by star contraction.

Large-star and small-star steps take turns (Kiveris et al., 2014) until nothing moves: each
links every node to the smallest neighbour of one of its neighbours, which keeps the
components and shrinks their depth at least by half. Only minima are aggregated, and those
before the shuffle, so a node with very many edges costs no task more than its join, which
AQE splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. Links the larger neighbours (or the smaller ones and the node) to the smallest of all."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node; component is its smallest node.

    Ids may be of any ordered type. Null ends and edges from a node to itself don't count;
    repeated edges count once; without edges the result is empty.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    now = saved(now.distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = saved(_star(saved(_star(now, True), "large-star"), False), "small-star")
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
