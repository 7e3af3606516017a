"""Queries of schema fulfilment and of age and currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import age, schema
from tidemark.operators.lineage import settled
from tidemark.plans import adapter
from tidemark.plans.adapter import ORIGIN, STEP_US, view
from tidemark.plans.registry import query

adapter.CTES |= {
    "rules": "SELECT m.class_id, e.* FROM scm m JOIN es e ON e.entity_schema_id = m.entity_schema_id",
    "d4": """SELECT DISTINCT v.revision_id, v.value_id, v.change_target, v.step, v.entity_id, v.property_id, v.action, v.datatype, v.new_value, v.old_value, r.entity_schema_id, r.min, r.max, r.value_constraint
  FROM vc v JOIN et t ON t.entity_id = v.entity_id JOIN rules r ON r.class_id = t.class_id AND r.property_id = v.property_id""",
    "d5": """SELECT DISTINCT v.step, r.entity_schema_id, v.entity_id, r.property_id, coalesce(r.min, 0) <= 0 AS within FROM vc v JOIN et t ON t.entity_id = v.entity_id JOIN rules r ON r.class_id = t.class_id
  WHERE v.action = 'CREATE' AND v.target = 'ENTITY'""",
    "okd": """SELECT *, CASE value_constraint WHEN 'entity' THEN new_value LIKE 'Q%' WHEN 'time' THEN new_value LIKE '+%' WHEN 'number' THEN new_value <> '{}'
    WHEN 'some' THEN new_value IN ('Q7', 'Q8', 'Q9') WHEN 'german' THEN false ELSE true END AS ok_new,
  CASE value_constraint WHEN 'entity' THEN old_value LIKE 'Q%' WHEN 'time' THEN old_value LIKE '+%' WHEN 'number' THEN old_value <> '{}'
    WHEN 'some' THEN old_value IN ('Q7', 'Q8', 'Q9') WHEN 'german' THEN false ELSE true END AS ok_old FROM d4""",
    "mv": """SELECT step, entity_schema_id, entity_id, property_id,
  sum((CASE WHEN ok_new AND action <> 'DELETE' THEN 1 ELSE 0 END) - (CASE WHEN ok_old AND action <> 'CREATE' THEN 1 ELSE 0 END)) AS c,
  sum((CASE WHEN NOT ok_new AND action <> 'DELETE' THEN 1 ELSE 0 END) - (CASE WHEN NOT ok_old AND action <> 'CREATE' THEN 1 ELSE 0 END)) AS n FROM okd GROUP BY step, entity_schema_id, entity_id, property_id
  UNION ALL SELECT step, entity_schema_id, entity_id, property_id, 0, 0 FROM d5""",
    "d6": """SELECT x.step, x.entity_schema_id, x.entity_id, x.property_id, compliant, noncompliant, (e.min IS NULL OR compliant >= e.min) AND (e.max IS NULL OR compliant <= e.max) AS within
  FROM (SELECT s.step, m.entity_schema_id, m.entity_id, m.property_id, CAST(sum(m.c) AS BIGINT) AS compliant, CAST(sum(m.n) AS BIGINT) AS noncompliant FROM spine s JOIN mv m ON m.step <= s.step GROUP BY s.step, m.entity_schema_id, m.entity_id, m.property_id) x
  JOIN es e ON e.entity_schema_id = x.entity_schema_id AND e.property_id = x.property_id""",
    "d12": """SELECT step, entity_id, coalesce(last_bad + 1, f) AS since FROM (SELECT step, entity_id, whole, max(CASE WHEN NOT whole THEN step END) OVER w AS last_bad, min(step) OVER w AS f
  FROM (SELECT step, entity_id, bool_or(compliant + noncompliant > 0) AND bool_and(noncompliant = 0 AND within) AS whole FROM d6 GROUP BY step, entity_id) y WINDOW w AS (PARTITION BY entity_id ORDER BY step)) z WHERE whole""",
    "aev": """SELECT value_id, property_id, us, revision_id, CASE WHEN datatype = 'time' AND action <> 'DELETE' THEN epoch_us(CAST(substr(new_value, 2, 10) AS TIMESTAMP)) END AS value_at FROM vc WHERE datatype = 'time' OR action IN ('DELETE', 'UPDATE')""",
    "alive": """SELECT s.step, a.value_id, a.property_id, a.us, a.value_at FROM (SELECT *, lead(us) OVER (PARTITION BY value_id ORDER BY us, revision_id) AS nxt FROM aev) a
  JOIN spine s ON 1704067200000000 + (s.step + 1) * 259200000000 > a.us AND 1704067200000000 + (s.step + 1) * 259200000000 <= least(coalesce(a.nxt, 4611686018427387904), a.us + 7775999999999)
  WHERE a.value_at IS NOT NULL""",
    "dly": "SELECT *, (us - value_at) / 86400000000 AS delay FROM alive",
    "cur": """SELECT z.step, z.entity_id, (1704067200000000 + (z.since + 1) * 259200000000 - h.t) / 1e6 AS age_seconds FROM d12 z JOIN
  (SELECT s.step, v.entity_id, max(epoch_us(CAST(substr(v.new_value, 2, 10) AS TIMESTAMP))) AS t FROM (SELECT v.*, lead(v.us) OVER (PARTITION BY v.entity_id, v.value_id ORDER BY v.us, v.revision_id) AS nxt FROM vc v JOIN et t ON t.entity_id = v.entity_id
    JOIN scm m ON m.class_id = t.class_id WHERE v.property_id = 569 AND m.entity_schema_id IN (1, 3)) v
   JOIN spine s ON v.us < 1704067200000000 + (s.step + 1) * 259200000000 AND 1704067200000000 + (s.step + 1) * 259200000000 <= coalesce(v.nxt, 4611686018427387904) WHERE v.action <> 'DELETE' GROUP BY s.step, v.entity_id) h
  ON h.step = z.step AND h.entity_id = z.entity_id""",
}
adapter.ORDER[:] = list(adapter.CTES)
#: What the adapter's short constraint names stand for, in ShEx's JSON form.
NODES = {
    "entity": '{"type": "NodeConstraint", "values": [{"type": "IriStem", "stem": "http://www.wikidata.org/entity/"}]}',
    "time": '{"type": "NodeConstraint", "datatype": "http://www.w3.org/2001/XMLSchema#dateTime"}',
    "number": '{"type": "NodeConstraint", "datatype": "http://www.w3.org/2001/XMLSchema#decimal"}',
    "some": """{"type": "ShapeOr", "shapeExprs": [{"type": "NodeConstraint", "values": ["http://www.wikidata.org/entity/Q7", "http://www.wikidata.org/entity/Q8"],
"datatype": "http://www.w3.org/2001/XMLSchema#string"}, {"type": "NodeConstraint", "values": ["http://www.wikidata.org/entity/Q6"], "datatype": "http://www.w3.org/2001/XMLSchema#decimal"},
{"type": "Shape", "expression": {"type": "EachOf", "expressions": [{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P31", "valueExpr": {"type": "Odd"}},
{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/statement/P279", "valueExpr": {"type": "NodeConstraint", "values": ["http://www.wikidata.org/entity/Q9"]}}]}}]}""",
    "german": '{"type": "NodeConstraint", "values": [{"type": "Language", "languageTag": "de"}, {"type": "Language", "languageTag": "en"}]}',
    "english": '{"type": "NodeConstraint", "values": [{"type": "Language", "languageTag": "en"}]}',
}


def rules(s: SparkSession, d: str) -> DataFrame:
    node = F.col("value_constraint")
    for k, v in NODES.items():
        node = F.when(F.col("value_constraint") == k, v).otherwise(node)
    return view(s, d, "es").withColumn("value_constraint", node)


def parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return view(s, d, "vc"), view(s, d, "et"), view(s, d, "scm"), rules(s, d)


def edits(s: SparkSession, d: str) -> DataFrame:
    return schema.with_compliance(schema.schema_edits(*parts(s, d)))


def states(s: SparkSession, d: str) -> DataFrame:
    return schema.fulfilment_states(edits(s, d), schema.schema_created(*parts(s, d)), rules(s, d))


def spine(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "spine")


query("d3", "SELECT revision_id, entity_schema_id, ok_new, ok_old FROM okd")(lambda s, d: edits(s, d).select("revision_id", "entity_schema_id", "ok_new", "ok_old"))
query("d4", "SELECT revision_id, entity_schema_id, entity_id, property_id, action FROM d4")(lambda s, d: schema.schema_edits(*parts(s, d)).select("revision_id", "entity_schema_id", "entity_id", "property_id", "action"))
query("d5", "SELECT * FROM d5")(lambda s, d: schema.schema_created(*parts(s, d)))
query("d6", "SELECT * FROM d6")(lambda s, d: schema.fulfilment_counts(states(s, d), spine(s, d)))
OK = "bool_and(noncompliant = 0 AND within <o>)"
D7 = "SELECT step, avg(share) AS value FROM (SELECT step, entity_id, avg(CASE WHEN ok THEN 1.0e0 ELSE 0 END) AS share FROM (SELECT step, entity_id, property_id, " + OK + " AS ok FROM d6 GROUP BY step, entity_id, property_id) x GROUP BY step, entity_id) y GROUP BY step"
D9 = "SELECT step, entity_schema_id, avg(share) AS value FROM (SELECT step, entity_schema_id, entity_id, avg(CASE WHEN noncompliant = 0 AND within <o> THEN 1.0e0 ELSE 0 END) AS share FROM d6 GROUP BY step, entity_schema_id, entity_id) x GROUP BY step, entity_schema_id"
query("d7", D7.replace("<o>", ""))(lambda s, d: schema.fulfilment(states(s, d), spine(s, d)))
query("d8", D7.replace("<o>", "AND compliant >= 1"))(lambda s, d: schema.fulfilment(states(s, d), spine(s, d), optional=True))
query("d9", D9.replace("<o>", ""))(lambda s, d: schema.fulfilment_per_schema(states(s, d), spine(s, d)))
query("d10", D9.replace("<o>", "AND compliant >= 1"))(lambda s, d: schema.fulfilment_per_schema(states(s, d), spine(s, d), optional=True))
query("d11", "SELECT step, entity_schema_id, property_id, avg(CASE WHEN compliant > 0 OR noncompliant > 0 THEN 1.0e0 ELSE 0 END) AS value FROM d6 GROUP BY step, entity_schema_id, property_id")(lambda s, d: schema.property_occurrence(states(s, d), spine(s, d)))
query("d12", "SELECT * FROM d12")(lambda s, d: schema.time_complete(states(s, d), spine(s, d)))
@query("d13", "SELECT step, value AS stored, value + 1 AS again FROM (" + D7.replace("<o>", "") + ") z WHERE step = 9")
def d13(s: SparkSession, d: str) -> DataFrame:
    """A stored series against one that differs in its last step."""
    series = settled(schema.fulfilment(states(s, d), spine(s, d)))
    return schema.replay(series, series.withColumn("value", F.when(F.col("step") == 9, F.col("value") + 1).otherwise(F.col("value"))))


#: Fixed value: a small ShExJ document.
SHEX = """{"type": "Schema", "start": "s", "shapes": [{"type": "Shape", "id": "s", "extra": ["http://www.wikidata.org/prop/direct/P5"], "expression": {"type": "EachOf", "expressions": [
{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P31", "valueExpr": {"type": "NodeConstraint", "values": ["http://www.wikidata.org/entity/Q5"]}},
{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/P569", "min": 0, "max": -1},
{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P5"},
{"type": "TripleConstraint", "predicate": "http://www.wikidata.org/prop/direct/P569", "min": 0, "max": 2}]}}]}"""


D1 = """SELECT n_nationkey AS entity_schema_id, 31 AS property_id, 1 AS min, 1 AS max, concat('{"type": "NodeConstraint", "values": ["http://www.wikidata.org/entity/Q', CAST(n_nationkey AS STRING), '"]}') AS value_constraint FROM nation
UNION ALL SELECT n_nationkey, 569, 0, -1, NULL FROM nation UNION ALL SELECT n_nationkey, 569, 0, 2, NULL FROM nation"""


@query("d1", D1)
def d1(s: SparkSession, d: str) -> DataFrame:
    """Rows of ShExJ documents, one per nation, that differ in the value they ask for."""
    text = F.replace(F.lit(SHEX), F.lit("entity/Q5"), F.concat(F.lit("entity/Q"), F.col("n_nationkey").cast("string")))
    return schema.flatten_schemas(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("entity_schema_id"), text.alias("text")))


query("d2", f"SELECT entity_schema_id, property_id, max(min) AS min, min(CASE WHEN max >= 0 THEN max END) AS max, max(value_constraint) AS value_constraint FROM ({D1}) x GROUP BY entity_schema_id, property_id")(
    lambda s, d: schema.merge_schemas(d1(s, d))
)


def alive(s: SparkSession, d: str) -> DataFrame:
    return age.active(age.age_events(view(s, d, "vc")), view(s, d, "spine"), ORIGIN, STEP_US)


E5 = """SELECT step, property_id, avg(CASE WHEN delay BETWEEN 0 AND 90 THEN 1 - greatest(0, (delay - 3) / 87) END) AS scaled_score, avg(CASE WHEN delay BETWEEN 0 AND 90 THEN delay END) AS avg_delay_days,
count(*) FILTER (WHERE delay > 3) AS late, count(*) FILTER (WHERE delay > 90) AS too_old, count(*) FILTER (WHERE delay < 0) AS future, count(*) AS statements, count(*) FILTER (WHERE delay BETWEEN 0 AND 90) AS eligible FROM dly GROUP BY step, property_id"""
query("e1", "SELECT revision_id, CAST(epoch_us(CAST(substr(new_value, 2, 10) AS TIMESTAMP)) / 1000000 AS BIGINT) AS seconds FROM vc WHERE datatype = 'time'")(
    lambda s, d: view(s, d, "vc").where("datatype = 'time'").select("revision_id", F.unix_timestamp(age.parse_time_value(F.col("new_value"))).alias("seconds"))
)
query("e2", "SELECT revision_id FROM vc WHERE datatype = 'time' AND substr(new_value, 2, 10) >= '2023-12-01'")(
    lambda s, d: view(s, d, "vc").where("datatype = 'time'").where(age.in_scope(age.parse_time_value(F.col("new_value")), "2023-12-01")).select("revision_id")
)
query("e3", "SELECT revision_id, round(exp(-(us - 1704067200000000) / 1e6 * ln(2) / 31536000), 9) AS score FROM vc")(
    lambda s, d: view(s, d, "vc").select("revision_id", F.round(age.exp_decay((F.col("us") - ORIGIN) / 1e6), 9).alias("score"))
)
query("e4", "SELECT step, value_id, property_id, us, value_at FROM alive")(alive)
query("e5", E5)(lambda s, d: age.age_scores(alive(s, d)))
query("e5_global", f"SELECT step, sum(scaled_score * eligible) / sum(eligible) AS value FROM ({E5}) x GROUP BY step HAVING sum(eligible) > 0")(lambda s, d: age.age_global(age.age_scores(alive(s, d))))


def ranks(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(569, 1), (1081, 2)], "property_id int, rank int")


def happened(s: SparkSession, d: str) -> DataFrame:
    return age.time_happened_changes(view(s, d, "vc"), view(s, d, "et"), view(s, d, "scm"), age.best_time_property(view(s, d, "es"), ranks(s)))


def current(s: SparkSession, d: str) -> DataFrame:
    return age.currency(happened(s, d), schema.complete_states(states(s, d)), spine(s, d), ORIGIN, STEP_US)


query("e6", "SELECT entity_schema_id, property_id, CAST(rank AS INT) AS rank FROM (SELECT e.*, r.rank, row_number() OVER (PARTITION BY entity_schema_id ORDER BY rank, e.property_id) AS p FROM es e JOIN (VALUES (569, 1), (1081, 2)) r(property_id, rank) ON r.property_id = e.property_id) x WHERE p = 1")(
    lambda s, d: age.best_time_property(view(s, d, "es"), ranks(s))
)
query("e7", "SELECT v.revision_id, v.entity_id, 1 AS rank, list(DISTINCT t.class_id) AS classes FROM vc v JOIN et t ON t.entity_id = v.entity_id JOIN scm m ON m.class_id = t.class_id WHERE v.property_id = 569 AND m.entity_schema_id IN (1, 3) GROUP BY v.revision_id, v.entity_id")(
    lambda s, d: happened(s, d).select("revision_id", "entity_id", "rank", "classes")
)
MEANS = "avg(age_seconds) / 31536000 AS age_years, avg(exp(-age_seconds * ln(2) / 31536000)) AS score, count(*) AS entities FROM cur"
query("e8", f"SELECT step, {MEANS} WHERE age_seconds >= 0 GROUP BY step")(lambda s, d: age.currency_means(current(s, d)))
query("e8_class", f"SELECT cur.step, et.class_id, {MEANS} JOIN et ON et.entity_id = cur.entity_id WHERE age_seconds >= 0 GROUP BY cur.step, et.class_id")(lambda s, d: age.currency_means(current(s, d), view(s, d, "et")))
query("e9", "SELECT step, exp(-avg(age_seconds) * ln(2) / 31536000) AS value FROM cur WHERE age_seconds >= 0 GROUP BY step")(
    lambda s, d: age.decay_of(current(s, d).groupBy("step").agg(F.avg("age_seconds").alias("value")))
)
query("e10", "SELECT property_id, step, exp(-avg(delay) * 86400 * ln(2) / 31536000) AS value FROM dly WHERE delay >= 0 GROUP BY property_id, step")(
    lambda s, d: age.decay_of(alive(s, d).where("us >= value_at").groupBy("property_id", "step").agg(F.avg((F.col("us") - F.col("value_at")) / 1e6).alias("value")))
)
