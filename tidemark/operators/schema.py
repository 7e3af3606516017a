"""Entity schemas: flattening, value compliance, and fulfilment per entity and schema."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import settled
from tidemark.operators.steps import accumulated, moved, spread

#: Pseudo properties of labels and descriptions, and the predicates that name a property.
LABEL, DESCRIPTION = -1, -2
PREDICATE = re.compile(r"/prop/(?:direct/)?P(\d+)$")
TEXT_PREDICATES = {"http://www.w3.org/2000/01/rdf-schema#label": LABEL, "http://schema.org/description": DESCRIPTION}


def flatten_schema(schema_id: int, text: str) -> list[tuple[int, int, int | None, int | None, str | None]]:
    """(schema, property, min, max, value constraint) of a ShExJ document's start shape; -1 as max is unbounded."""
    doc = json.loads(text)
    shapes = {s.get("id"): s.get("shapeExpr", s) for s in doc.get("shapes", [])}
    start = doc.get("start")
    start = shapes.get(start) if isinstance(start, str) else start
    todo = [start] if start and start.get("type") == "Shape" else list((start or {}).get("shapeExprs", [])) if (start or {}).get("type") == "ShapeAnd" else []
    out = []
    while todo:
        shape = todo.pop(0)
        shape = shapes.get(shape) if isinstance(shape, str) else shape
        if not shape or shape.get("type") != "Shape":
            continue
        extra, parts = set(shape.get("extra", [])), [shape.get("expression")]
        while parts:
            e = parts.pop(0)
            if not isinstance(e, dict):
                continue
            if e.get("type") in ("EachOf", "OneOf"):
                parts = list(e.get("expressions", [])) + parts
            elif e.get("type") == "TripleConstraint" and e.get("predicate") not in extra:
                m = PREDICATE.search(e["predicate"])
                prop = int(m[1]) if m else TEXT_PREDICATES.get(e["predicate"])
                if prop is not None:
                    value = e.get("valueExpr")
                    out.append((schema_id, prop, e.get("min", 1), e.get("max", 1), None if value is None else json.dumps(value, sort_keys=True)))
    return out


def flatten_schemas(documents: DataFrame) -> DataFrame:
    """The rows of all documents (entity_schema_id, text); one that can't be read is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for i, text in zip(part["entity_schema_id"], part["text"], strict=True) for r in flatten_schema(int(i), text)]
            out = pd.DataFrame(rows, columns=["entity_schema_id", "property_id", "min", "max", "value_constraint"])
            yield out.astype({"min": "Int32", "max": "Int32"})

    return documents.select("entity_schema_id", "text").mapInPandas(run, "entity_schema_id int, property_id int, min int, max int, value_constraint string")


def merge_schemas(rows: DataFrame) -> DataFrame:
    """One row per (schema, property): the tightest bounds (-1 is unbounded) and all value constraints; rows that constrain nothing go."""
    top = F.min(F.when(F.col("max") >= 0, F.col("max")))
    each = F.array_sort(F.collect_set("value_constraint"))
    merged = rows.groupBy("entity_schema_id", "property_id").agg(F.max("min").alias("min"), top.alias("max"), each.alias("each"))
    both = F.concat(F.lit('{"type": "ShapeAnd", "shapeExprs": ['), F.array_join("each", ", "), F.lit("]}"))
    value = F.when(F.size("each") == 1, F.get("each", F.lit(0))).when(F.size("each") > 1, both)
    out = merged.select("entity_schema_id", "property_id", "min", "max", value.alias("value_constraint"))
    return out.where((F.coalesce("min", F.lit(0)) > 0) | F.col("max").isNotNull() | F.col("value_constraint").isNotNull())


#: What stems and datatypes the rules know, and the predicates of a property's value.
ENTITY_STEMS = ("http://www.wikidata.org/entity", "http://www.wikidata.org/entity/")
FILE_STEM = "http://commons.wikimedia.org/wiki/Special:FilePath"
LANGUAGE = "en"
DIRECT = "http://www.wikidata.org/prop/statement/P", "http://www.wikidata.org/prop/direct/P"


def _date(value: object) -> bool:
    datetime.fromisoformat(value.removeprefix("+"))
    return True


def _number(value: object) -> bool:
    float(value)
    return True


#: What a value of each datatype is. An error means that it isn't one.
DATATYPES: dict[str, Callable[[object], bool]] = {
    "http://www.opengis.net/ont/geosparql#wktLiteral": lambda v: all(type(v[k]) in (int, float) for k in ("longitude", "latitude")),
    "http://www.w3.org/2001/XMLSchema#dateTime": _date,
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString": lambda v: isinstance(v, str),
    "http://www.w3.org/2001/XMLSchema#string": lambda v: isinstance(v, str),
    "http://www.w3.org/2001/XMLSchema#decimal": _number,
}


def _listed(entry: object, value: object) -> bool | None:
    """What an entry of a list of allowed values says of value; None if the next one is to decide."""
    if isinstance(entry, str):
        return True if entry.rsplit("/", 1)[-1] == value else None
    kind = entry.get("type") if isinstance(entry, dict) else None
    if kind == "Language":
        return entry.get("languageTag") == LANGUAGE
    if kind == "IriStem" and entry.get("stem") in ENTITY_STEMS:
        return isinstance(value, str) and len(value) > 1 and value.startswith("Q")
    return True if kind == "IriStem" and entry.get("stem") == FILE_STEM else None


def _is_a(datatype: str, value: object) -> bool:
    try:
        return DATATYPES.get(datatype, lambda v: True)(value)
    except Exception:  # noqa: BLE001 - whatever goes wrong, it isn't one
        return False


def complies(node: dict | str | None, value: object, property_id: int) -> bool:
    """Whether a statement's value (read from JSON) satisfies a ShEx node.

    References to other shapes count as satisfied; unknown nodes, and values that are neither text, object nor fraction, as not. A node
    with both a list of values and a datatype asks for both. A TripleConstraint speaks of its own property only.
    """
    if node is None or isinstance(node, str):
        return True
    if type(value) not in (str, dict, float):
        return False

    def inner(nodes: Sequence) -> Iterator[bool]:
        return (complies(n, value, property_id) for n in nodes)

    kind = node.get("type")
    if kind == "NodeConstraint":
        said = next((x for x in (_listed(e, value) for e in node["values"]) if x is not None), False) if "values" in node else True
        return said and ("datatype" not in node or _is_a(node["datatype"], value))
    if kind == "TripleConstraint":
        return node.get("predicate") not in [p + str(property_id) for p in DIRECT] or complies(node.get("valueExpr"), value, property_id)
    if kind in ("EachOf", "ShapeAnd"):
        return all(inner(node["expressions" if kind == "EachOf" else "shapeExprs"]))
    if kind == "ShapeOr":
        return any(inner(node["shapeExprs"]))
    return kind == "Shape" and complies(node.get("expression"), value, property_id)


def read_value(text: str | None) -> object:
    """A stored value: text, an object or a list in JSON, or else the text itself, as amounts are."""
    try:
        return json.loads(text) if text and text[0] in '"{[' else text
    except ValueError:
        return text


def with_compliance(rows: DataFrame) -> DataFrame:
    """Adds ok_new and ok_old: whether new_value and old_value satisfy value_constraint. Evaluated once per distinct (constraint, property, value) of
    both sides; null where the constraint can't be read, true without one."""

    @F.pandas_udf("boolean")
    def judge(constraint: pd.Series, properties: pd.Series, values: pd.Series) -> pd.Series:
        read: dict[str, dict | None] = {}
        result = []
        for c, p, v in zip(constraint, properties, values, strict=True):
            if c not in read:
                try:
                    read[c] = json.loads(c)
                except ValueError:
                    read[c] = None
            result.append(None if read[c] is None else complies(read[c], read_value(v), p))
        return pd.Series(result, dtype="object")

    rows = settled(rows)
    both = rows.where("value_constraint is not null").select(F.col("value_constraint").alias("c"), F.col("property_id").alias("p"), F.explode(F.array("new_value", "old_value")).alias("v")).distinct()
    judged = settled(both.withColumn("ok", judge("c", "p", "v")))
    for side in ("new", "old"):
        own = judged.withColumnRenamed("ok", f"ok_{side}")
        same = F.expr(f"c = value_constraint and p = property_id and v <=> {side}_value")
        rows = rows.join(own, same, "left").drop("c", "p", "v").withColumn(f"ok_{side}", F.when(F.col("value_constraint").isNull(), True).otherwise(F.col(f"ok_{side}")))
    return rows


def schema_edits(changes: DataFrame, types: DataFrame, mapping: DataFrame, schemas: DataFrame) -> DataFrame:
    """Edits with each schema property they bear on. The rule tables are small and Spark broadcasts them where that is so; entity_type is not."""
    rules = mapping.join(schemas, "entity_schema_id")
    typed = types.select("entity_id", "class_id").distinct().join(rules, "class_id").drop("class_id").distinct()
    return changes.join(typed, ["entity_id", "property_id"]).dropDuplicates(["revision_id", "value_id", "change_target", "entity_schema_id"])


def schema_created(changes: DataFrame, types: DataFrame, mapping: DataFrame, schemas: DataFrame) -> DataFrame:
    """(step, entity_schema_id, entity_id, property_id, within): the properties that a new entity's schemas ask for."""
    rules = mapping.join(schemas, "entity_schema_id")
    new = changes.where("action = 'CREATE' and target = 'ENTITY'").select("step", "entity_id").distinct()
    typed = types.select("entity_id", "class_id").distinct().join(rules, "class_id")
    return new.join(typed, "entity_id").select("step", "entity_schema_id", "entity_id", "property_id", (F.coalesce("min", F.lit(0)) <= 0).alias("within")).distinct()


KEYS = ["entity_schema_id", "entity_id", "property_id"]


def fulfilment_states(edits: DataFrame, created: DataFrame, schemas: DataFrame) -> DataFrame:
    """(schema, entity, property, step, until, compliant, noncompliant, within): a key's state from each step in which it changes until the next.

    edits has ok_new and ok_old. A new value adds one to its side unless it is deleted, an old one takes one away unless it
    is created; edits whose compliance is unknown don't count. Values that comply are held against the bounds.
    """

    def one(flag: str, unless: str, sign: int) -> Column:
        known = F.col(flag).isNotNull() & (F.col("action") != unless)
        return F.struct(F.when(known & F.col(flag), sign).otherwise(0).alias("c"), F.when(known & ~F.col(flag), sign).otherwise(0).alias("n"))

    moves = edits.select("step", *KEYS, one("ok_new", "DELETE", 1).alias("new"), one("ok_old", "CREATE", -1).alias("old")).select(
        "step", *KEYS, (F.col("new.c") + F.col("old.c")).alias("compliant"), (F.col("new.n") + F.col("old.n")).alias("noncompliant")
    )
    zero = F.lit(0)
    moves = moves.unionByName(created.select("step", *KEYS, zero.alias("compliant"), zero.alias("noncompliant"))).groupBy("step", *KEYS)
    sums = accumulated(moves.agg(F.sum("compliant").alias("compliant"), F.sum("noncompliant").alias("noncompliant")), KEYS, ["compliant", "noncompliant"])
    n = F.col("compliant")
    within = (F.col("min").isNull() | (n >= F.col("min"))) & (F.col("max").isNull() | (F.col("max") < 0) | (n <= F.col("max")))
    bounds = schemas.select("entity_schema_id", "property_id", "min", "max")
    return sums.join(bounds, ["entity_schema_id", "property_id"]).select("step", *KEYS, "compliant", "noncompliant", within.alias("within"), "until")


def fulfilment_counts(states: DataFrame, spine: DataFrame) -> DataFrame:
    """The states, a row for every step from a key's first on."""
    return spread(states, spine)


def _complete(optional: bool) -> Column:
    ok = (F.col("noncompliant") == 0) & F.col("within")
    return ok & (F.col("compliant") >= 1) if optional else ok


def _mean_share(moves: DataFrame, keys: Sequence[str], spine: DataFrame, by: Sequence[str]) -> DataFrame:
    """(step, by..., value): mean over keys of ok / n; moves has by how much both change."""
    shares = accumulated(moves, keys, ["ok", "n"]).withColumn("share", F.col("ok") / F.col("n"))
    return spread(shares, spine).groupBy("step", *by).agg(F.avg("share").alias("value"))


def fulfilment(states: DataFrame, spine: DataFrame, optional: bool = False) -> DataFrame:
    """(step, value): mean over entities of the share of their properties that all of their schemas' rows find complete."""
    pairs = ["entity_id", "property_id"]
    bad = accumulated(moved(states, KEYS, {"bad": ~_complete(optional)}, pairs), pairs, ["bad", "n"])
    return _mean_share(moved(bad, pairs, {"ok": F.col("bad") == 0}, ["entity_id"]), ["entity_id"], spine, [])


def fulfilment_per_schema(states: DataFrame, spine: DataFrame, optional: bool = False) -> DataFrame:
    keys = ["entity_schema_id", "entity_id"]
    return _mean_share(moved(states, KEYS, {"ok": _complete(optional)}, keys), keys, spine, ["entity_schema_id"])


def property_occurrence(states: DataFrame, spine: DataFrame) -> DataFrame:
    keys = ["entity_schema_id", "property_id"]
    used = (F.col("compliant") > 0) | (F.col("noncompliant") > 0)
    sums = accumulated(moved(states, KEYS, {"used": used}, keys), keys, ["used", "n"])
    return spread(sums, spine).select("step", *keys, (F.col("used") / F.col("n")).alias("value"))


def complete_states(states: DataFrame) -> DataFrame:
    """(entity_id, step, until, since): when an entity is complete, and the step in which that run of completeness began."""
    flags = {"any": (F.col("compliant") + F.col("noncompliant")) > 0, "bad": (F.col("noncompliant") != 0) | ~F.col("within")}
    sums = accumulated(moved(states, KEYS, flags, ["entity_id"]), ["entity_id"], ["any", "bad"])
    by = Window.partitionBy("entity_id").orderBy("step")
    whole = (F.col("any") > 0) & (F.col("bad") == 0)
    rows = sums.select("step", "entity_id", "until", whole.alias("whole"))
    begins = F.when(F.col("whole") & ~F.coalesce(F.lag("whole").over(by), F.lit(False)), F.col("step"))
    since = F.last("begin", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("begin", begins).withColumn("since", since).where("whole").select("step", "entity_id", "until", "since")


def time_complete(states: DataFrame, spine: DataFrame) -> DataFrame:
    """(step, entity_id, since): of the entities complete in step, the step in which their present run of completeness began."""
    return spread(complete_states(states), spine)


def replay(stored: DataFrame, again: DataFrame, keys: Sequence[str] = ("step",), tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stored value differs from the one computed again, or that one of them lacks."""
    both = stored.withColumnRenamed("value", "stored").join(again.withColumnRenamed("value", "again"), list(keys), "full")
    same = F.coalesce(F.abs(F.col("stored") - F.col("again")) <= tolerance, F.lit(False))
    return both.where(~same)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
