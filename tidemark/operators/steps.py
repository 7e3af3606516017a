"""States over steps without a grid: rows at the steps where a state changes, and the steps that each lasts for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def horizon(spine: DataFrame) -> Column:
    """The last step of spine."""
    return spine.agg(F.max("step")).scalar()


def floor_div(x: Column, n: int) -> Column:
    """x / n rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def accumulated(moves: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums so far of columns per key at each step in moves (one row a key and step), and until, the key's next such step."""
    by = Window.partitionBy(*keys).orderBy("step")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    return moves.select("step", *keys, *(F.sum(c).over(so_far).alias(c) for c in columns), F.lead("step").over(by).alias("until"))


def moved(states: DataFrame, keys: Sequence[str], flags: dict[str, Column], to: Sequence[str]) -> DataFrame:
    """By how much the number of keys with each flag changes per step and coarser key ``to``; n is that of all keys."""
    by = Window.partitionBy(*keys).orderBy("step")
    each = states.select("step", *keys, *(f.cast("int").alias(c) for c, f in flags.items()))
    was = each.select("step", *to, *((F.col(c) - F.lag(c, 1, 0).over(by)).alias(c) for c in flags), F.when(F.lag("step").over(by).isNull(), 1).otherwise(0).alias("n"))
    return was.groupBy("step", *to).agg(*(F.sum(c).alias(c) for c in [*flags, "n"]))


def spread(states: DataFrame, spine: DataFrame) -> DataFrame:
    """A row per step that each state lasts for, from its step to before until (null: to the end of spine)."""
    end = horizon(spine)
    last = F.least(F.coalesce(F.col("until") - 1, end), end)
    rows = states.withColumn("until", last).where("step <= until")
    return rows.withColumn("step", F.explode(F.sequence("step", "until"))).drop("until")
