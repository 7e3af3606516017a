"""Age of data when it was written, and how current complete entities are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import exp_decay, in_scope, parse_time_value
from tidemark.operators.steps import floor_div, spread

DAY_US = 86400 * 1000000
EXPIRY_DAYS = 90


def age_events(changes: DataFrame) -> DataFrame:
    """Edits that set or clear a statement's time: value_at is its time in microseconds, null where it is cleared."""
    parsed = parse_time_value(F.col("new_value"))
    value = F.when((F.col("datatype") == "time") & (F.col("action") != "DELETE") & in_scope(parsed), F.unix_micros(parsed))
    kept = changes.where((F.col("datatype") == "time") | (F.col("action").isin("DELETE", "UPDATE")))
    return kept.select("value_id", "property_id", "us", "revision_id", value.alias("value_at"))


def active(events: DataFrame, spine: DataFrame, origin_us: int, step_us: int, days: int = EXPIRY_DAYS) -> DataFrame:
    """Per step end T the statements whose last event before T set a time, less than ``days`` ago.

    Each event is alive from itself to the next event of its statement or its expiry, so it is put
    into the steps that end in that interval; no state is carried.
    """
    nxt = F.lead("us").over(Window.partitionBy("value_id").orderBy("us", "revision_id"))
    # last event < T and T - days < written; the next event, if before T, ends it
    end = F.least(F.coalesce(nxt, F.lit(2**62)), F.col("us") + days * DAY_US - 1)
    spans = events.withColumns({"step": first_end(F.col("us"), origin_us, step_us), "until": last_end(end, origin_us, step_us) + 1}).where("value_at is not null")
    return spread(spans, spine).where("step >= 0").select("step", "value_id", "property_id", "us", "value_at")


def first_end(us: Column, origin_us: int, step_us: int) -> Column:
    """The first step that ends after us."""
    return floor_div(us - origin_us, step_us)


def last_end(us: Column, origin_us: int, step_us: int) -> Column:
    """The last step that ends at us or before."""
    return floor_div(us - origin_us, step_us) - 1


def age_scores(alive: DataFrame) -> DataFrame:
    """Per step and property: mean score and delay of what was written at most 90 days late, and how many were late, too old, in the future."""
    delay = (F.col("us") - F.col("value_at")) / DAY_US
    past, eligible = delay >= 0, (delay >= 0) & (delay <= EXPIRY_DAYS)
    score = 1 - F.greatest(F.lit(0.0), (delay - 3) / 87)

    def when(c: Column, v: Column) -> Column:
        return F.avg(F.when(c, v))

    return alive.groupBy("step", "property_id").agg(
        when(eligible, score).alias("scaled_score"),
        when(eligible, delay).alias("avg_delay_days"),
        F.count_if(past & (delay > 3)).alias("late"),
        F.count_if(delay > EXPIRY_DAYS).alias("too_old"),
        F.count_if(delay < 0).alias("future"),
        F.count("*").alias("statements"),
        F.count_if(eligible).alias("eligible"),
    )


def age_global(scores: DataFrame) -> DataFrame:
    """Mean score per step over all eligible statements."""
    by = scores.groupBy("step").agg(F.sum(F.col("scaled_score") * F.col("eligible")).alias("s"), F.sum("eligible").alias("n"))
    return by.select("step", F.try_divide("s", "n").alias("value")).where("value is not null")


def best_time_property(schemas: DataFrame, ranks: DataFrame) -> DataFrame:
    """The time property of best rank of each schema: ranks has property_id and rank."""
    place = F.row_number().over(Window.partitionBy("entity_schema_id").orderBy("rank", "property_id"))
    return schemas.select("entity_schema_id", "property_id").join(ranks, "property_id").withColumn("_p", place).where("_p = 1").drop("_p")


def time_happened_changes(changes: DataFrame, types: DataFrame, mapping: DataFrame, best: DataFrame) -> DataFrame:
    """Time edits of entities with a ranked property: the smallest rank and the classes it comes from."""
    ranked = mapping.join(best.select("entity_schema_id", F.col("property_id").alias("_p"), "rank"), "entity_schema_id")
    typed = types.select("entity_id", "class_id").distinct().join(ranked, "class_id")
    rows = changes.where("datatype = 'time'").join(typed, (changes["entity_id"] == typed["entity_id"]) & (changes["property_id"] == typed["_p"])).drop(typed["entity_id"])
    return rows.groupBy("revision_id", "entity_id", "value_id", "us", "action", "new_value").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("class_id")).alias("classes")).where("rank is not null")


def happened_states(happened: DataFrame, origin_us: int, step_us: int) -> DataFrame:
    """(entity_id, step, until, t): the latest time of the best rank among an entity's values, from a step on and until another; null where it has none."""
    nxt = F.coalesce(F.lead("us").over(Window.partitionBy("entity_id", "value_id").orderBy("us", "revision_id")), F.lit(2**62))
    at = F.unix_micros(parse_time_value(F.col("new_value")))
    spans = happened.select("entity_id", "rank", "action", at.alias("t"), first_end(F.col("us"), origin_us, step_us).alias("first"), last_end(nxt, origin_us, step_us).alias("last"))
    spans = spans.where("action <> 'DELETE' and t is not null and first <= last").drop("action")
    cuts = spans.select("entity_id", F.explode(F.array("first", F.col("last") + 1)).alias("step")).distinct()
    live = cuts.join(spans, "entity_id").where("step between first and last").groupBy("entity_id", "step", "rank").agg(F.max("t").alias("t"))
    best = live.groupBy("entity_id", "step").agg(F.min_by("t", "rank").alias("t"))
    return cuts.join(best, ["entity_id", "step"], "left").withColumn("until", F.lead("step").over(Window.partitionBy("entity_id").orderBy("step")))


def currency(happened: DataFrame, complete: DataFrame, spine: DataFrame, origin_us: int, step_us: int) -> DataFrame:
    """(step, entity_id, age_seconds, score): how long after it happened a complete entity was complete; negative ages are dropped.

    complete has states (entity_id, step, until, since). An age is the same for as long as both states last, so steps are only spread out at the end.
    """
    t = happened_states(happened, origin_us, step_us).select("entity_id", F.col("step").alias("tfrom"), F.coalesce("until", F.lit(2**62)).alias("tuntil"), "t").where("t is not null")
    both = complete.withColumn("until", F.coalesce("until", F.lit(2**62))).join(t, "entity_id").withColumns({"step": F.greatest("step", "tfrom", F.lit(0)), "until": F.least("until", "tuntil")})
    done = both.where("step < until").withColumn("age_seconds", (F.lit(origin_us) + (F.col("since") + 1) * step_us - F.col("t")) / 1e6).where("age_seconds >= 0")
    return spread(done, spine).select("step", "entity_id", "age_seconds", exp_decay(F.col("age_seconds")).alias("score"))


def currency_means(rows: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Mean age in years of 365 days, mean score and count, per step (and class)."""
    if types is not None:
        rows = rows.join(types.select("entity_id", "class_id").distinct(), "entity_id")
    keys = ["step"] if types is None else ["step", "class_id"]
    return rows.groupBy(*keys).agg((F.avg("age_seconds") / (365 * 86400)).alias("age_years"), F.avg("score").alias("score"), F.count("*").alias("entities"))


def decay_of(series: DataFrame, missing: float = -1.0) -> DataFrame:
    """The decay of another series' values, rows of ``missing`` left out."""
    return series.where(F.col("value") != missing).withColumn("value", exp_decay(F.col("value")))
