"""Property constraints: rules, violations of ranges, required classes, and inverse statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import coerce_numeric, qid_int, time_parts
from tidemark.operators.counters import running
from tidemark.operators.lineage import settled

#: Ids of constraint types, qualifiers and relations.
RANGE, SUBJECT_TYPE = "Q21510860", "Q21503250"
MIN_VALUE, MAX_VALUE, MIN_DATE, MAX_DATE = "P2313", "P2312", "P2310", "P2311"
CLASS, RELATION, EXCEPTION, STATUS = "P2308", "P2309", "P2303", "P2316"
MANDATORY, SUGGESTION = "Q21502408", "Q62026391"
INSTANCE_OF, SUBCLASS_OF, EITHER = "Q21503252", "Q21514624", "Q30208840"


def load(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Constraint rows with property ids as numbers."""
    out = rows.withColumn("property_id", qid_int(F.col("property_id")))
    return out if kind is None else out.where(F.col("constraint_type") == kind)


def type_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("constraint_type").agg(F.array_sort(F.collect_set("property_id")).alias("properties"))


def compile_rules(rows: DataFrame) -> DataFrame:
    """One rule per (property, type, rank) with its (qualifier, value) in row order; statements of equal rank are one rule."""
    params = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "qualifier_id", "qualifier_value"))), lambda x: F.struct(x["qualifier_id"].alias("id"), x["qualifier_value"].alias("value")))
    return rows.groupBy("property_id", "constraint_type", "rank").agg(params.alias("params"))


def first_param(params: Column, qualifier: str) -> Column:
    return F.get(F.filter(params, lambda p: p["id"] == qualifier), F.lit(0))["value"]


def all_params(params: Column, qualifier: str) -> Column:
    return F.transform(F.filter(params, lambda p: p["id"] == qualifier), lambda p: p["value"])


def status(params: Column) -> Column:
    """mandatory, suggestion or regular, by the first status parameter."""
    s = first_param(params, STATUS)
    return F.when(s == MANDATORY, "mandatory").when(s == SUGGESTION, "suggestion").otherwise("regular")


def range_bounds(rules: DataFrame, as_of: str) -> DataFrame:
    """(property_id, status, low, high, from, until): numbers, and dates as (year, month, day); a date bound of some value is as_of."""

    def date(q: str) -> Column:
        raw = first_param(F.col("params"), q)
        p = time_parts(F.when(raw == "somevalue", as_of).otherwise(raw))
        return F.when(p["year"].isNotNull(), F.struct(p["year"].alias("year"), p["month"].alias("month"), p["day"].alias("day")))

    def number(q: str) -> Column:
        return coerce_numeric(first_param(F.col("params"), q))

    return rules.where(F.col("constraint_type") == RANGE).select(
        "property_id", status(F.col("params")).alias("status"), number(MIN_VALUE).alias("low"), number(MAX_VALUE).alias("high"), date(MIN_DATE).alias("from"), date(MAX_DATE).alias("until")
    )


def out_of_range(value: Column, datatype: Column, low: Column, high: Column, start: Column, until: Column) -> Column:
    n, p = coerce_numeric(value), time_parts(value)
    day = F.struct(p["year"].alias("year"), p["month"].alias("month"), p["day"].alias("day"))
    number = F.coalesce(n < low, F.lit(False)) | F.coalesce(n > high, F.lit(False))
    date = p["year"].isNotNull() & (F.coalesce(day < start, F.lit(False)) | F.coalesce(day > until, F.lit(False)))
    return F.coalesce(F.when(datatype == "quantity", number).when(datatype == "time", date), F.lit(False))


def violation_diffs(changes: DataFrame, bounds: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """(step, property_id, d): new values that violate any rule less old ones that did. A changes row counts once, whatever its rules."""
    rules = bounds if statuses is None else bounds.where(F.col("status").isin(*statuses))
    packed = rules.groupBy("property_id").agg(F.collect_list(F.struct("low", "high", "from", "until")).alias("rules"))

    def broken(value: str) -> Column:
        return F.exists("rules", lambda r: out_of_range(F.col(value), F.col("datatype"), r["low"], r["high"], r["from"], r["until"])).cast("int")

    rows = changes.join(packed, "property_id")
    new = F.when(F.col("action") != "DELETE", broken("new_value")).otherwise(0)
    old = F.when(F.col("action") != "CREATE", broken("old_value")).otherwise(0)
    return rows.groupBy("step", "property_id").agg(F.sum(new - old).cast("long").alias("d"))


def violation_counts(diffs: DataFrame, spine: DataFrame) -> DataFrame:
    """Running count per property, never below 0; a property that a step doesn't touch is only written where the step touches none."""
    rows = running(diffs, spine, ["property_id"], floored=True)
    touched = diffs.select("step", "property_id").distinct().withColumn("t", F.lit(1))
    any_ = F.max("t").over(Window.partitionBy("step"))
    return rows.join(touched, ["step", "property_id"], "left").withColumn("_any", any_).where("t is not null or _any is null").select("step", "property_id", "value")


def closure(edges: DataFrame, child: str = "entity_id", parent: str = "class_id") -> DataFrame:
    """(node, ancestor) of a hierarchy that may have cycles; a node isn't its own ancestor.

    Paths double in length with each round, and only pairs that are new go on; rounds are written to the checkpoint folder.
    """
    base = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node <> ancestor").distinct()
    base = settled(base)
    all_, new = base, base
    while new.take(1):
        left = all_.select("node", F.col("ancestor").alias("mid")).join(new.select(F.col("node").alias("mid"), "ancestor"), "mid")
        right = new.select("node", F.col("ancestor").alias("mid")).join(all_.select(F.col("node").alias("mid"), "ancestor"), "mid")
        found = left.unionByName(right).select("node", "ancestor").where("node <> ancestor").distinct()
        new = settled(found.join(all_, ["node", "ancestor"], "left_anti"))
        all_ = settled(all_.unionByName(new))
    return all_


def presence(events: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(step, keys, present): net per step added to what was there, kept within 0 and 1."""
    n = spine.count()
    by = events.groupBy("step", *keys).agg(F.sum("d").alias("d")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "d"))).alias("m"))

    def clamp(acc: Column, t: Column) -> Column:
        s = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + F.coalesce(F.try_element_at(F.col("m"), t.cast("long")), F.lit(0).cast("long"))
        return F.concat(acc, F.array(F.greatest(F.lit(0).cast("long"), F.least(F.lit(1).cast("long"), s))))

    states = by.select(*keys, F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<bigint>"), clamp).alias("v"))
    return states.select(*keys, F.posexplode("v").alias("step", "present")).where("present = 1").select(F.col("step").cast("long").alias("step"), *keys)


def subject_violators(pairs: DataFrame, types: DataFrame, up: DataFrame, rules: DataFrame) -> DataFrame:
    """The (entity_id, property_id) of pairs that fail a rule of their property.

    rules has rule, property_id, classes, relation and exceptions. An entity satisfies a rule if it is excepted, or it is an
    instance or subclass (as the relation asks) of one of the classes or of what lies below them.
    """
    rows = pairs.join(rules, "property_id")
    asked = rules.select("rule", "relation", F.explode("classes").alias("wanted"))
    below = up.select(F.col("node").alias("cls"), F.col("ancestor").alias("wanted"))
    good = asked.select("rule", "relation", "wanted", F.col("wanted").alias("cls")).unionByName(asked.join(below, "wanted").select("rule", "relation", "wanted", "cls")).select("rule", "relation", "cls").distinct()
    direct = types.select("entity_id", F.col("class_id").alias("cls")).distinct()
    instance = direct.join(good.where(F.col("relation").isin(INSTANCE_OF, EITHER)), "cls").select("entity_id", "rule")
    subclass = good.where(F.col("relation").isin(SUBCLASS_OF, EITHER)).select(F.col("cls").alias("entity_id"), "rule")
    fine = instance.unionByName(subclass).distinct()
    excepted = F.array_contains("exceptions", F.col("entity_id"))
    return rows.where(~F.coalesce(excepted, F.lit(False))).join(fine, ["entity_id", "rule"], "left_anti").select("entity_id", "property_id").distinct()


def subject_violations(counts: DataFrame, violators: DataFrame) -> DataFrame:
    """(property_id, value): statements of the violating entities; counts has entity_id, property_id and n."""
    return counts.join(violators, ["entity_id", "property_id"]).groupBy("property_id").agg(F.sum("n").cast("double").alias("value"))


def inverse_violations(statements: DataFrame, inverse: DataFrame) -> DataFrame:
    """(property_id, value): present statements (entity, property, target) whose inverse (target, inverse property, entity) is absent."""
    wanted = statements.select("entity_id", "property_id", "target").distinct().join(inverse, "property_id")
    have = statements.select(F.col("entity_id").alias("target"), F.col("property_id").alias("inverse_id"), F.col("target").alias("entity_id")).distinct()
    lost = wanted.join(have, ["entity_id", "inverse_id", "target"], "left_anti")
    return lost.groupBy("property_id").agg(F.count("*").cast("double").alias("value"))
