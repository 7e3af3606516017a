"""Queries of the running counters and of the metric algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import algebra, counters
from tidemark.plans.adapter import view
from tidemark.plans.registry import query

CUM = "SELECT s.step, CAST(coalesce(sum(d.d) OVER (ORDER BY s.step), 0) AS DOUBLE) AS value FROM spine s LEFT JOIN d ON d.step = s.step"
N = {
    "entity": "count(*) FILTER (WHERE action = 'CREATE' AND target = 'ENTITY')",
    "property": "count(*) FILTER (WHERE action = 'CREATE' AND target IN ('PROPERTY', 'ENTITY')) - count(*) FILTER (WHERE action = 'DELETE' AND target = 'PROPERTY')",
    "statement": "count(*) FILTER (WHERE action = 'CREATE' AND target IN ('ENTITY', 'PROPERTY', 'PROPERTY_VALUE')) - count(*) FILTER (WHERE action = 'DELETE' AND target IN ('PROPERTY', 'PROPERTY_VALUE'))",
    "plain": "count(*) FILTER (WHERE action = 'CREATE') - count(*) FILTER (WHERE action = 'DELETE')",
}


def cum(diff: str, source: str = "vc", where: str = "true") -> str:
    return f"WITH d AS (SELECT step, {diff} AS d FROM {source} WHERE {where} GROUP BY step)\n{CUM}"


def _vc(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vc")


def _spine(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "spine")


query("c1", cum(N["entity"]))(lambda s, d: counters.entity_count(_vc(s, d), _spine(s, d)))
query("c2", cum(N["property"]))(lambda s, d: counters.property_count(_vc(s, d), _spine(s, d)))
query("c3", cum(N["statement"]))(lambda s, d: counters.statement_count(_vc(s, d), _spine(s, d)))
query("c4", cum(N["property"], where="property_id = 279"))(lambda s, d: counters.property_count(_vc(s, d), _spine(s, d), 279))
query("c5", cum("count(*)", "ev"))(lambda s, d: counters.revision_count(view(s, d, "ev"), _spine(s, d)))
query("c6", cum(N["plain"], "rc"))(lambda s, d: counters.created_less_deleted(view(s, d, "rc"), _spine(s, d)))
query("c7", cum(N["plain"], where="property_id = -1"))(lambda s, d: counters.text_property_count(_vc(s, d), _spine(s, d), -1))
query("c8", cum(N["plain"], where="property_id = -2"))(lambda s, d: counters.text_property_count(_vc(s, d), _spine(s, d), -2))

PER_VALUE = """WITH g AS (SELECT s.step, v.value_id FROM spine s, (SELECT DISTINCT value_id FROM rc) v),
x AS (SELECT g.step, g.value_id, coalesce(d.d, 0) AS d FROM g LEFT JOIN (SELECT step, value_id, sum(CASE WHEN action = 'CREATE' THEN 1 ELSE -1 END) AS d FROM rc GROUP BY step, value_id) d
  ON d.step = g.step AND d.value_id = g.value_id),
c AS (SELECT *, sum(d) OVER (PARTITION BY value_id ORDER BY step) AS s FROM x),
f AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY value_id ORDER BY step)) AS v FROM c)
SELECT step, CAST(count(*) FILTER (WHERE <v> > 0) AS DOUBLE) AS value FROM f GROUP BY step"""

query("c9", PER_VALUE.replace("<v>", "v"))(lambda s, d: counters.referenced_statements(view(s, d, "rc"), _spine(s, d)))
query("c10", PER_VALUE.replace("<v>", "s"))(lambda s, d: counters.referenced_statements(view(s, d, "rc"), _spine(s, d), floored=False))

PER_PROPERTY = """WITH d AS (SELECT step, property_id, count(*) FILTER (WHERE action = 'CREATE') - count(*) FILTER (WHERE action = 'DELETE') AS d FROM vc
  WHERE property_id IN (<p>) AND target IN ('PROPERTY', 'PROPERTY_VALUE', 'ENTITY') <and> GROUP BY step, property_id),
k AS (SELECT property_id, min(step) AS f FROM d GROUP BY property_id),
g AS (SELECT s.step, k.property_id FROM spine s JOIN k ON s.step >= k.f),
c AS (SELECT g.step, g.property_id, sum(coalesce(d.d, 0)) OVER (PARTITION BY g.property_id ORDER BY g.step) AS s FROM g LEFT JOIN d ON d.step = g.step AND d.property_id = g.property_id)
"""
query("c11", PER_PROPERTY.replace("<p>", "569, 1081").replace("<and>", "") + "SELECT step, property_id, CAST(s AS DOUBLE) AS value FROM c")(
    lambda s, d: counters.statements_of_properties(_vc(s, d), _spine(s, d), [569, 1081])
)


@query(
    "c12",
    PER_PROPERTY.replace("<p>", "31, 279, -1").replace("<and>", "AND property_id > 0 AND entity_id % 50 <> 0")
    + "SELECT step, property_id, CAST(s - least(0, min(s) OVER (PARTITION BY property_id ORDER BY step)) AS DOUBLE) AS value FROM c",
)
def c12(s: SparkSession, d: str) -> DataFrame:
    exempt = view(s, d, "et").where("entity_id % 50 = 0").select("entity_id", F.explode(F.array(F.lit(31), F.lit(279))).alias("property_id"))
    return counters.statements_subject(_vc(s, d), _spine(s, d), [31, 279, -1], exempt)


@query(
    "c13",
    PER_PROPERTY.replace("<p>", "31, 279").replace("<and>", "")
    + "SELECT step, property_id, CASE WHEN property_id = 31 THEN (s - s / 4) / 2 + s / 4 ELSE CAST(s AS DOUBLE) END AS value FROM c",
)
def c13(s: SparkSession, d: str) -> DataFrame:
    raw = counters.statements_of_properties(_vc(s, d), _spine(s, d), [31, 279])
    return counters.symmetric_statements(raw, raw.withColumn("value", F.col("value") / 4), [31])


query(
    "c14",
    "SELECT reference, CAST(sum(CASE WHEN action = 'CREATE' THEN 1 ELSE -1 END) AS BIGINT) AS score, count(*) FILTER (WHERE action = 'DELETE') AS deletes FROM rc GROUP BY reference",
)(lambda s, d: counters.reference_votes(view(s, d, "rc")))


def two(a: str, b: str, value: str) -> str:
    """SQL of a value of two or more running counters n0, n1, ..."""
    return a + b + value


COUNTS = f"""WITH d AS (SELECT step, {N['entity']} AS e, {N['statement']} AS s, {N['property']} AS p, count(*) FILTER (WHERE action = 'CREATE' AND property_id = -1) -
  count(*) FILTER (WHERE action = 'DELETE' AND property_id = -1) AS l FROM vc GROUP BY step),
n AS (SELECT s.step, CAST(coalesce(sum(d.e) OVER w, 0) AS DOUBLE) AS e, CAST(coalesce(sum(d.s) OVER w, 0) AS DOUBLE) AS s, CAST(coalesce(sum(d.p) OVER w, 0) AS DOUBLE) AS p,
  CAST(coalesce(sum(d.l) OVER w, 0) AS DOUBLE) AS l FROM spine s LEFT JOIN d ON d.step = s.step WINDOW w AS (ORDER BY s.step))
"""


@query("f1", COUNTS + "SELECT step, s / e AS value FROM n WHERE e <> 0")
def f1(s: SparkSession, d: str) -> DataFrame:
    vc, spine = _vc(s, d), _spine(s, d)
    return algebra.divide(counters.statement_count(vc, spine), counters.entity_count(vc, spine))


@query("f2", COUNTS + "SELECT step, s + p AS value FROM n")
def f2(s: SparkSession, d: str) -> DataFrame:
    vc, spine = _vc(s, d), _spine(s, d)
    return algebra.add(counters.statement_count(vc, spine), counters.property_count(vc, spine))


@query("f3", COUNTS + "SELECT step, 1 - p / s AS value FROM n WHERE s <> 0")
def f3(s: SparkSession, d: str) -> DataFrame:
    vc, spine = _vc(s, d), _spine(s, d)
    return algebra.complement(algebra.divide(counters.property_count(vc, spine), counters.statement_count(vc, spine)), spine)


@query("f4", COUNTS + "SELECT step, CASE WHEN e = 0 THEN 1.0 ELSE (l + 0) / (2 * e) END AS value FROM n")
def f4(s: SparkSession, d: str) -> DataFrame:
    vc, spine = _vc(s, d), _spine(s, d)
    return algebra.labelled_share(counters.text_property_count(vc, spine, -1), counters.text_property_count(vc, spine, -2), counters.entity_count(vc, spine))


def basic_statistics(s: SparkSession, d: str) -> algebra.MetricGraph:
    """The eight counters, their averages, and the share of labels and descriptions, as a graph."""
    vc, rc, ev, spine = _vc(s, d), view(s, d, "rc"), view(s, d, "ev"), _spine(s, d)
    g = algebra.MetricGraph()
    g.add("entity_count", lambda: counters.entity_count(vc, spine))
    g.add("property_count", lambda: counters.property_count(vc, spine))
    g.add("statement_count", lambda: counters.statement_count(vc, spine))
    g.add("subclass_count", lambda: counters.property_count(vc, spine, 279))
    g.add("revision_count", lambda: counters.revision_count(ev, spine))
    g.add("reference_count", lambda: counters.created_less_deleted(rc, spine))
    g.add("label_count", lambda: counters.text_property_count(vc, spine, -1))
    g.add("description_count", lambda: counters.text_property_count(vc, spine, -2))
    g.add("referenced_statements", lambda: counters.referenced_statements(rc, spine))
    g.add("avg_statements_per_entity", algebra.divide, "statement_count", "entity_count")
    g.add("avg_properties_per_entity", algebra.divide, "property_count", "entity_count")
    g.add("reference_completeness", algebra.divide, "referenced_statements", "statement_count")
    g.add("labelled_share", algebra.labelled_share, "label_count", "description_count", "entity_count")
    return g


@query("f5")
def f5(s: SparkSession, d: str) -> DataFrame:
    """The graph's levels: metric, level and number of inputs."""
    g = basic_statistics(s, d)
    rows = [(n, k, len(g.nodes[n][0])) for k, level in enumerate(g.levels()) for n in level]
    return s.createDataFrame(rows, "metric string, level int, needs int")


@query(
    "f6",
    COUNTS
    + """SELECT 'avg_statements_per_entity' AS metric, step, s / e AS value FROM n WHERE e <> 0
UNION ALL SELECT 'avg_properties_per_entity', step, p / e FROM n WHERE e <> 0
UNION ALL SELECT 'entity_count', step, e FROM n UNION ALL SELECT 'property_count', step, p FROM n UNION ALL SELECT 'statement_count', step, s FROM n""",
)
def f6(s: SparkSession, d: str) -> DataFrame:
    wanted = ["avg_statements_per_entity", "avg_properties_per_entity", "entity_count", "property_count", "statement_count"]
    out = [df.withColumn("metric", F.lit(n)) for n, df in basic_statistics(s, d).run(*wanted).items()]
    rows = out[0]
    for df in out[1:]:
        rows = rows.unionByName(df)
    return rows.select("metric", "step", "value")
