"""Analytics over result series."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fetch_series(store: DataFrame, run_id: int, metrics: Sequence[str], dim: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """Series of a run by metric (and id). A metric without rows is an error."""
    rows = store.where((F.col("run_id") == run_id) & F.col("metric").isin(*metrics))
    if dim is not None and ids is not None:
        rows = rows.where(F.col(dim).isin(*ids))
    have = {r["metric"] for r in rows.select("metric").distinct().collect()}  # at most the metrics asked for
    if lost := set(metrics) - have:
        raise KeyError(f"no such series: {sorted(lost)}")
    return rows


def fetch_aggregated(series: DataFrame, dim: str, ids: Sequence, how: str = "sum") -> DataFrame:
    """(step, value): sum or mean over ids. Ids without rows are an error."""
    rows = series.where(F.col(dim).isin(*ids))
    have = {r[0] for r in rows.select(dim).distinct().collect()}  # at most the ids asked for
    if lost := set(ids) - have:
        raise KeyError(f"no such {dim}: {sorted(lost)}")
    return rows.groupBy("step").agg((F.sum if how == "sum" else F.avg)("value").alias("value"))


def spikes(series: DataFrame, width: int, threshold: float, keys: Sequence[str] = ("metric",), limit: int | None = None, reserved: int | None = None) -> DataFrame:
    """Steps that rise above (direction 1) or drop below (-1) what surrounds them by threshold times the series' range.

    A step needs finite values within width places on both sides. Of spikes within width places the most prominent stays, at ties that of
    the larger absolute value, then the later; at most limit stay. Those within width of the place ``reserved`` are left out and
    don't count. Prominence is a window; picking is greedy, in one task a series.
    """
    by = Window.partitionBy(*keys).orderBy("step")
    whole = Window.partitionBy(*keys)
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value").cast("double"))
    rows = series.select(*keys, "step", "value", finite.alias("_v"), (F.row_number().over(by) - 1).alias("_i"), F.count("*").over(whole).alias("_n"))
    sides = [by.rowsBetween(-width, -1), by.rowsBetween(1, width)]
    # greatest and least skip nulls, so the place of both sides is asked for below
    up = F.col("_v") - F.greatest(*(F.min("_v").over(side) for side in sides))
    down = F.least(*(F.max("_v").over(side) for side in sides)) - F.col("_v")
    both = F.min("_v").over(sides[0]).isNotNull() & F.min("_v").over(sides[1]).isNotNull()
    rows = rows.select("*", F.when(both, F.greatest(up, down)).alias("prominence"), F.when(up >= down, 1).otherwise(-1).alias("direction"), (F.max("_v").over(whole) - F.min("_v").over(whole)).alias("_r"))
    found = rows.where((F.col("_n") >= 3) & (F.col("prominence") >= threshold * F.col("_r")) & (F.col("prominence") > 0)).drop("_r", "_n")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        order = pdf.assign(_v=pdf["_v"].abs()).sort_values(["prominence", "_v", "_i"], ascending=False)
        for k, place in order["_i"].items():
            if limit is not None and len(kept) >= max(limit, 1):  # the reference counts after it takes one
                break
            if (reserved is None or abs(place - reserved) > width) and all(abs(place - pdf["_i"][j]) > width for j in kept):
                kept.append(k)
        return pdf.loc[sorted(kept)]

    return found.groupBy(*keys).applyInPandas(pick, found.schema).drop("_v", "_i")


def run_metrics(catalogue: DataFrame, store: DataFrame) -> DataFrame:
    """Catalogue entries that a run has rows of."""
    return catalogue.join(store.select("metric").distinct(), "metric", "left_semi")


def written(series: DataFrame, dim: str) -> DataFrame:
    return series.groupBy(dim).agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"))


def latest(series: DataFrame, at: int, dim: str) -> DataFrame:
    """Values of the last step up to ``at``, with their share of all."""
    last = series.where(F.col("step") <= at).agg(F.max("step").alias("s"))
    rows = series.where(F.col("step") == last.scalar())
    return rows.select(dim, "value", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy())).alias("share"))


def age_inspection(scores: DataFrame) -> DataFrame:
    """Sums and means over steps per property: what is current is neither late nor in the future; a missing count is 0."""
    rows = scores.na.fill(0).withColumn("current", F.col("statements") - F.col("late") - F.col("future"))
    return rows.groupBy("property_id").agg(
        F.sum("current").alias("current"), F.sum("late").alias("late"), F.sum("future").alias("future"), F.avg(F.coalesce(F.try_divide("eligible", "statements"), F.lit(0.0))).alias("eligible_share")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("value", "other"), "step").withColumn("diff", F.col("other") - F.col("value"))
    return both.select("step", "value", "other", "diff", F.try_divide("diff", "value").alias("relative"))


def comparison_summary(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.avg(F.abs("diff")).alias("mean_abs"), F.max(F.abs("diff")).alias("max_abs"))


def fractions_without(classes: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """(step, class, fraction) of mass without the excluded domains. classes has step, domain, class and mass; without a class the result is NaN."""
    rows = classes.withColumn("out", F.col("domain").isin(*excluded))
    total = F.sum(F.sum(F.when(~F.col("out"), F.col("mass")).otherwise(0.0))).over(Window.partitionBy("step"))
    by = rows.groupBy("step", "class").agg(F.try_divide(F.sum(F.when(~F.col("out"), F.col("mass")).otherwise(0.0)), total).alias("fraction"))
    return by


def top_counts(classes: DataFrame) -> DataFrame:
    """Per step and class: domains, mass, and share of the step's mass."""
    total = F.sum(F.sum("mass")).over(Window.partitionBy("step"))
    return classes.groupBy("step", "class").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.try_divide(F.sum("mass"), total).alias("coverage"))


def end_state(classes: DataFrame) -> DataFrame:
    """Each domain's class and mass at its last step."""
    last = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("step")))
    return classes.withColumn("_r", last).where("_r = 1").drop("_r")


def stability(classes: DataFrame) -> DataFrame:
    """Per domain: steps in each class, changes of class, first and last class."""
    w = Window.partitionBy("domain").orderBy("step")
    rows = classes.withColumn("_c", F.coalesce((F.lag("class").over(w) != F.col("class")).cast("int"), F.lit(0)))

    def steps(c: str) -> Column:
        return F.count_if(F.col("class") == c).alias(c)

    return rows.groupBy("domain").agg(
        steps("dominated"), steps("contested"), steps("dominating"), F.sum("_c").alias("switches"), F.min_by("class", "step").alias("first"), F.max_by("class", "step").alias("last")
    )


def nearest(rows: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """As-of join: for each target step the nearest step of rows within tolerance, the earlier of two as near.

    Targets are cut into buckets of tolerance width and meet rows of their own and the neighbouring buckets: an equi join.
    """
    width = max(tolerance, 1)
    steps = rows.select("step").distinct().withColumn("_b", F.floor(F.col("step") / width))
    asked = targets.select("target").distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("target") / width) - 1, F.floor(F.col("target") / width) + 1)))
    near = asked.join(steps, "_b").withColumn("_d", F.abs(F.col("step") - F.col("target"))).where(F.col("_d") <= tolerance)
    best = near.groupBy("target").agg(F.min(F.struct("_d", "step")).alias("m")).select("target", F.col("m.step").alias("step"))
    return best.join(rows, "step")


def top_k(rows: DataFrame, k: int, by: Sequence[str], value: str = "mass", name: str = "domain") -> DataFrame:
    """Top k per group with rank and share, ties by name."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), name))).withColumn("share", F.try_divide(F.col(value), F.sum(value).over(w)))
    return ranked.where(F.col("rank") <= k)


def top_overall(rows: DataFrame, k: int) -> DataFrame:
    """Top k with share and cumulative share. The total is aggregated; only the k rows meet in one task."""
    total = rows.agg(F.sum("mass").alias("t"))
    best = rows.orderBy(F.desc("mass"), "domain").limit(k).withColumn("share", F.try_divide(F.col("mass"), total.scalar()))
    w = Window.orderBy(F.desc("mass"), "domain")
    return best.select("domain", "mass", "share", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), F.row_number().over(w).alias("rank"))


def stats_summary(series: DataFrame, keys: Sequence[str], at: int) -> DataFrame:
    known = F.col("step") <= at
    return series.groupBy(*keys).agg(
        F.max_by(F.when(known, F.col("value")), F.when(known, F.col("step"))).alias("as_of"), F.min_by("value", "step").alias("first"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("*").alias("n")
    )


def compare_classifiers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(class_a, class_b, domains): how two classifiers meet; unclassified where one has none."""
    both = a.select("domain", F.col("class").alias("class_a")).join(b.select("domain", F.col("class").alias("class_b")), "domain", "full")
    return both.groupBy(F.coalesce("class_a", F.lit("unclassified")).alias("class_a"), F.coalesce("class_b", F.lit("unclassified")).alias("class_b")).agg(F.count("*").alias("domains"))


def group_share(mass: DataFrame, names: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Per step: mass of the domains listed or below a suffix, and its share."""
    inside = F.col("domain").isin(*names) if names else F.lit(False)
    for s in suffixes:
        inside = inside | (F.col("domain") == s) | F.col("domain").endswith("." + s)
    held = F.sum(F.when(inside, F.col("mass")).otherwise(0.0))
    return mass.groupBy("step").agg(held.alias("mass"), F.try_divide(held, F.sum("mass")).alias("share"))


def runtimes_aligned(a: DataFrame, b: DataFrame, drop_last: int = 0, strict: bool = False) -> DataFrame:
    """(step, a, b): summed seconds of the steps that both have. strict: steps that only one has are an error."""
    x, y = (r.groupBy("step").agg(F.sum("seconds").alias(n)) for r, n in ((a, "a"), (b, "b")))
    if strict and (x.join(y, "step", "left_anti").take(1) or y.join(x, "step", "left_anti").take(1)):
        raise ValueError("the runs have different steps")
    both = x.join(y, "step")
    last = F.row_number().over(Window.orderBy(F.desc("step")))
    return both.withColumn("_r", last).where(F.col("_r") > drop_last).drop("_r") if drop_last else both


def memory_profile(snapshots: DataFrame) -> DataFrame:
    """Process memory split into the database's part and the rest, per step."""
    return snapshots.select("step", "process_mb", "database_mb", (F.col("process_mb") - F.col("database_mb")).alias("other_mb"))


def mass_fractions(series: DataFrame, pattern: str) -> DataFrame:
    """(step, setting, metric, fraction): a setting read from the metric's name; fractions of each step's and setting's sum."""
    named = series.withColumn("setting", F.regexp_extract("metric", pattern, 1))
    return named.select("step", "setting", "metric", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("step", "setting"))).alias("fraction"))


def top_blocks(classes: DataFrame, block: int, k: int) -> DataFrame:
    """Per block of steps and class: mean mass of each domain over the block, top k."""
    by = classes.groupBy(F.floor(F.col("step") / block).alias("block"), "class", "domain").agg((F.sum("mass") / block).alias("mass"))
    return top_k(by, k, ["block", "class"]).drop("share")
