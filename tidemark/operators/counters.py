"""Running counters per step (and key): conditional sums, then a window over a full spine of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.steps import accumulated, spread


def assign_step(df: DataFrame, ts: str, origin_us: int, step_us: int) -> DataFrame:
    """Adds step: an event exactly at a boundary belongs to the step that begins there. Arithmetic, not a range join."""
    return df.withColumn("step", F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(origin_us)) / F.lit(step_us)).cast("long"))


def create(*targets: str) -> Column:
    return (F.col("action") == "CREATE") & F.col("target").isin(*targets)


def delete(*targets: str) -> Column:
    return (F.col("action") == "DELETE") & F.col("target").isin(*targets)


def signed(plus: Column, minus: Column | None = None) -> Column:
    """The diff of a group: how many rows satisfy plus, less those that satisfy minus."""
    total = F.count_if(plus)
    return (total if minus is None else total - F.count_if(minus)).cast("long")


def step_diffs(changes: DataFrame, diff: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(step, keys..., d). Aggregates before it shuffles."""
    return changes.groupBy("step", *keys).agg(diff.alias("d"))


def running(diffs: DataFrame, spine: DataFrame, keys: Sequence[str] = (), floored: bool = False) -> DataFrame:
    """(step, keys..., value) for each step of spine; with keys, from a key's first step on.

    floored: a sum that falls below 0 in a step goes on from 0 - the running sum less its smallest value below 0 so far.
    """
    if keys:
        every = accumulated(diffs, keys, ["d"]).withColumnRenamed("d", "s")
    else:
        filled = spine.join(diffs, "step", "left").withColumn("d", F.coalesce("d", F.lit(0)))
        every = accumulated(filled, keys, ["d"]).withColumnRenamed("d", "s")
    so_far = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("s") - F.least(F.lit(0), F.min("s").over(so_far)) if floored else F.col("s")
    out = every.withColumn("value", value.cast("double")).drop("s")
    return (spread(out, spine) if keys else out).select("step", *keys, "value")


def entity_count(changes: DataFrame, spine: DataFrame) -> DataFrame:
    return running(step_diffs(changes, signed(create("ENTITY"))), spine)


def property_count(changes: DataFrame, spine: DataFrame, only: int | None = None) -> DataFrame:
    rows = changes if only is None else changes.where(F.col("property_id") == only)
    return running(step_diffs(rows, signed(create("PROPERTY", "ENTITY"), delete("PROPERTY"))), spine)


def statement_count(changes: DataFrame, spine: DataFrame) -> DataFrame:
    return running(step_diffs(changes, signed(create("ENTITY", "PROPERTY", "PROPERTY_VALUE"), delete("PROPERTY", "PROPERTY_VALUE"))), spine)


def revision_count(revisions: DataFrame, spine: DataFrame) -> DataFrame:
    return running(step_diffs(revisions, F.count("*")), spine)


def created_less_deleted(rows: DataFrame, spine: DataFrame) -> DataFrame:
    return running(step_diffs(rows, signed(F.col("action") == "CREATE", F.col("action") == "DELETE")), spine)


def text_property_count(changes: DataFrame, spine: DataFrame, property_id: int) -> DataFrame:
    """Labels (-1) or descriptions (-2)."""
    return created_less_deleted(changes.where(F.col("property_id") == property_id), spine)


def referenced_statements(references: DataFrame, spine: DataFrame, floored: bool = True) -> DataFrame:
    """Statements with a reference. floored: a statement's count starts again at 0 after a step that ends below it;
    otherwise the count only moves as a statement's sum turns positive or falls back to exactly 0."""
    change = F.sum(F.when(F.col("action") == "CREATE", 1).otherwise(-1))
    diffs = references.where("change_target = ''").groupBy("step", "value_id").agg(change.alias("d"))
    so_far = Window.partitionBy("value_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = diffs.withColumn("s", F.sum("d").over(so_far))
    value = F.col("s") - F.least(F.lit(0), F.min("s").over(so_far)) if floored else F.col("s")
    sums = sums.withColumn("v", value)
    was = F.coalesce(F.lag("v").over(Window.partitionBy("value_id").orderBy("step")), F.lit(0))
    if floored:
        move = (F.col("v") > 0).cast("int") - (was > 0).cast("int")
    else:
        move = F.when((was <= 0) & (F.col("v") > 0), 1).when((was > 0) & (F.col("v") <= 0), -1).otherwise(0)
    moved = sums.withColumn("m", move).groupBy("step").agg(F.sum("m").alias("d"))
    return running(moved, spine)


def statements_of_properties(changes: DataFrame, spine: DataFrame, properties: Sequence[int]) -> DataFrame:
    """Per property; all of ENTITY, PROPERTY and PROPERTY_VALUE count."""
    rows = changes.where(F.col("property_id").isin(*properties) & F.col("target").isin("PROPERTY", "PROPERTY_VALUE", "ENTITY"))
    return running(step_diffs(rows, signed(F.col("action") == "CREATE", F.col("action") == "DELETE"), ["property_id"]), spine, ["property_id"])


def statements_subject(changes: DataFrame, spine: DataFrame, properties: Sequence[int], exempt: DataFrame) -> DataFrame:
    """As above without the (property_id, entity_id) in exempt, never below 0 per property."""
    rows = changes.where(F.col("property_id").isin(*properties) & (F.col("property_id") > 0) & F.col("target").isin("PROPERTY", "PROPERTY_VALUE", "ENTITY"))
    rows = rows.join(exempt, ["property_id", "entity_id"], "left_anti")
    diffs = step_diffs(rows, signed(F.col("action") == "CREATE", F.col("action") == "DELETE"), ["property_id"])
    return running(diffs, spine, ["property_id"], floored=True)


def symmetric_statements(raw: DataFrame, violations: DataFrame, symmetric: Sequence[int]) -> DataFrame:
    """(step, property_id, value): pairs of a symmetric property count once, its violations fully."""
    both = raw.join(violations.withColumnRenamed("value", "v"), ["step", "property_id"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    value = F.when(F.col("property_id").isin(*symmetric), (F.col("value") - F.col("v")) / 2 + F.col("v")).otherwise(F.col("value"))
    return both.select("step", "property_id", value.alias("value"))


def reference_votes(references: DataFrame) -> DataFrame:
    """(reference, score, deletes): creations less deletions of each reference value."""
    return references.groupBy("reference").agg(
        F.sum(F.when(F.col("action") == "CREATE", 1).otherwise(-1)).cast("long").alias("score"), F.count_if(F.col("action") == "DELETE").alias("deletes")
    )
