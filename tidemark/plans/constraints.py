"""Queries of property constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import algebra, constraints, counters
from tidemark.plans import adapter
from tidemark.plans.adapter import view
from tidemark.plans.registry import query
from tidemark.plans.trust import raw_query

ROWS = [
    ("P1081", "Q21510860", "NORMAL", "P2313", "+30", 1), ("P1081", "Q21510860", "NORMAL", "P2312", "60", 2), ("P1081", "Q21510860", "PREFERRED", "P2313", "10", 3),
    ("P1081", "Q21510860", "PREFERRED", "P2316", "Q21502408", 4), ("P569", "Q21510860", "NORMAL", "P2310", "+2023-12-01T00:00:00Z", 5),
    ("P569", "Q21510860", "NORMAL", "P2311", "somevalue", 6), ("P31", "Q21503250", "NORMAL", "P2308", "Q100", 7), ("P31", "Q21503250", "NORMAL", "P2309", "Q21503252", 8),
    ("P31", "Q21503250", "NORMAL", "P2303", "Q13", 9), ("P279", "Q21503250", "NORMAL", "P2308", "Q3", 10),
]
VALUES = "(VALUES " + ", ".join(f"('{p}', '{t}', '{r}', '{q}', '{v}', {n})" for p, t, r, q, v, n in ROWS) + ") t(property_id, constraint_type, rank, qualifier_id, qualifier_value, row_no)"
AS_OF = "2024-01-15"
adapter.CTES |= {
    "con": f"SELECT CAST(substr(property_id, 2) AS INT) AS property_id, constraint_type, rank, qualifier_id, qualifier_value, row_no FROM {VALUES}",
    "viol": """SELECT step, property_id, CAST(sum((CASE WHEN action <> 'DELETE' AND bad_new THEN 1 ELSE 0 END) - (CASE WHEN action <> 'CREATE' AND bad_old THEN 1 ELSE 0 END)) AS BIGINT) AS d FROM
  (SELECT *, CASE WHEN property_id = 1081 THEN new_value <> '{}' AND (TRY_CAST(new_value AS DOUBLE) < 30 OR TRY_CAST(new_value AS DOUBLE) > 60) ELSE new_value <> '{}' AND (substr(new_value, 2, 10) < '2023-12-01' OR substr(new_value, 2, 10) > '2024-01-15') END AS bad_new,
    CASE WHEN property_id = 1081 THEN old_value <> '{}' AND (TRY_CAST(old_value AS DOUBLE) < 30 OR TRY_CAST(old_value AS DOUBLE) > 60) ELSE old_value <> '{}' AND (substr(old_value, 2, 10) < '2023-12-01' OR substr(old_value, 2, 10) > '2024-01-15') END AS bad_old
   FROM vc WHERE property_id IN (1081, 569)) x GROUP BY step, property_id""",
    "eps": "SELECT entity_id, property_id, count(*) AS n FROM vc WHERE action = 'CREATE' AND property_id IN (31, 279) GROUP BY entity_id, property_id",
}
adapter.ORDER[:] = list(adapter.CTES)


def rows(s: SparkSession) -> DataFrame:
    return constraints.load(s.createDataFrame(ROWS, "property_id string, constraint_type string, rank string, qualifier_id string, qualifier_value string, row_no int"))


def rules(s: SparkSession) -> DataFrame:
    return constraints.compile_rules(rows(s))


def bounds(s: SparkSession) -> DataFrame:
    return constraints.range_bounds(rules(s), AS_OF)


query("g1", "SELECT property_id, constraint_type, qualifier_id, qualifier_value FROM con WHERE constraint_type = 'Q21510860'")(
    lambda s, d: rows(s).where("constraint_type = 'Q21510860'").select("property_id", "constraint_type", "qualifier_id", "qualifier_value")
)
query("g2", "SELECT constraint_type, list(DISTINCT property_id ORDER BY property_id) AS properties FROM con GROUP BY constraint_type")(lambda s, d: constraints.type_map(rows(s)))
query("g3", "SELECT property_id, constraint_type, rank, string_agg(qualifier_id || '=' || qualifier_value, ';' ORDER BY row_no) AS params FROM con GROUP BY property_id, constraint_type, rank")(
    lambda s, d: rules(s).select("property_id", "constraint_type", "rank", F.array_join(F.transform("params", lambda p: F.concat(p["id"], F.lit("="), p["value"])), ";").alias("params"))
)
query("g4", "SELECT revision_id, CASE WHEN new_value LIKE 'Q%' THEN CAST(substr(new_value, 2) AS INT) END AS qid, CASE WHEN datatype = 'quantity' THEN CAST(new_value AS DOUBLE) END AS number FROM vc")(
    lambda s, d: view(s, d, "vc").select("revision_id", values.qid_int(F.col("new_value")).alias("qid"), values.coerce_numeric(F.col("new_value")).alias("number"))
)


def diffs(s: SparkSession, d: str, statuses=None) -> DataFrame:
    return constraints.violation_diffs(view(s, d, "vc"), bounds(s), statuses)


RUN = """WITH k AS (SELECT property_id, min(step) AS f FROM viol GROUP BY property_id), g AS (SELECT s.step, k.property_id FROM spine s JOIN k ON s.step >= k.f),
c AS (SELECT g.step, g.property_id, v.d IS NOT NULL AS touched, sum(coalesce(v.d, 0)) OVER (PARTITION BY g.property_id ORDER BY g.step) AS s FROM g LEFT JOIN viol v ON v.step = g.step AND v.property_id = g.property_id),
r AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY property_id ORDER BY step)) AS DOUBLE) AS value, bool_or(touched) OVER (PARTITION BY step) AS anyone FROM c)
"""
query("g5", "SELECT * FROM viol")(diffs)
query("g6", RUN + "SELECT step, property_id, value FROM r WHERE touched OR NOT anyone")(lambda s, d: constraints.violation_counts(diffs(s, d), view(s, d, "spine")))
query("g7", "SELECT property_id, CASE WHEN property_id = 1081 AND rank = 'PREFERRED' THEN 'mandatory' ELSE 'regular' END AS status, CASE WHEN property_id = 1081 THEN CAST(max(qualifier_value) FILTER (WHERE qualifier_id = 'P2313') AS DOUBLE) END AS low, CAST(max(qualifier_value) FILTER (WHERE qualifier_id = 'P2312') AS DOUBLE) AS high FROM con WHERE constraint_type = 'Q21510860' GROUP BY property_id, rank")(
    lambda s, d: bounds(s).select("property_id", "status", "low", "high")
)
query("g8")(lambda s, d: constraints.violation_counts(diffs(s, d, ["mandatory"]), view(s, d, "spine")))


def hierarchy(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "sc")


def subject_rules(s: SparkSession) -> DataFrame:
    """What ``subject_violators`` takes, from compiled rules."""
    r = rules(s).where(F.col("constraint_type") == constraints.SUBJECT_TYPE)

    def ids(q: str):
        return F.transform(constraints.all_params(F.col("params"), q), lambda x: values.qid_int(x).cast("long"))

    return r.select(
        F.concat_ws("/", "property_id", "rank").alias("rule"), "property_id", ids(constraints.CLASS).alias("classes"),
        F.coalesce(constraints.first_param(F.col("params"), constraints.RELATION), F.lit(constraints.EITHER)).alias("relation"), ids(constraints.EXCEPTION).alias("exceptions"),
    )


def created(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vc").where("action = 'CREATE' and property_id in (31, 279)").groupBy("entity_id", "property_id").agg(F.count("*").alias("n"))


def violators(s: SparkSession, d: str) -> DataFrame:
    return constraints.subject_violators(created(s, d).drop("n"), view(s, d, "et"), constraints.closure(hierarchy(s, d)), subject_rules(s))


CLOSE = """WITH RECURSIVE up AS (SELECT entity_id AS node, class_id AS ancestor FROM sc UNION SELECT up.node, sc.class_id FROM up JOIN sc ON sc.entity_id = up.ancestor)
"""


def recursive(text: str) -> str:
    whole = adapter.sql(text.replace("WITH RECURSIVE", "WITH", 1), "duckdb")
    return whole if whole.startswith("WITH RECURSIVE") else whole.replace("WITH ", "WITH RECURSIVE ", 1)


BAD = """,
fine AS (SELECT t.entity_id, 31 AS property_id FROM et t WHERE t.class_id = 100 OR t.class_id IN (SELECT node FROM up WHERE ancestor = 100)
  UNION SELECT t.entity_id, 279 FROM et t WHERE t.class_id = 3 OR t.class_id IN (SELECT node FROM up WHERE ancestor = 3) UNION SELECT node, 279 FROM up WHERE ancestor = 3 UNION SELECT 3, 279 UNION SELECT 13, 31),
bad AS (SELECT e.* FROM eps e WHERE (e.entity_id, e.property_id) NOT IN (SELECT (entity_id, property_id) FROM fine))
"""
raw_query("g9", recursive(CLOSE.rstrip() + BAD + "SELECT property_id, CAST(sum(n) AS DOUBLE) AS value FROM bad GROUP BY property_id"))(lambda s, d: constraints.subject_violations(created(s, d), violators(s, d)))
raw_query("g10", recursive(CLOSE + "SELECT DISTINCT node, ancestor FROM up WHERE node <> ancestor"))(lambda s, d: constraints.closure(hierarchy(s, d)))
G11 = """WITH RECURSIVE b AS (SELECT s.step, k.value_id, CAST(coalesce(x.d, 0) AS BIGINT) AS d FROM spine s CROSS JOIN (SELECT DISTINCT value_id FROM vc WHERE property_id = 31) k
  LEFT JOIN (SELECT step, value_id, sum(CASE action WHEN 'CREATE' THEN 1 WHEN 'DELETE' THEN -1 ELSE 0 END) AS d FROM vc WHERE property_id = 31 GROUP BY step, value_id) x ON x.step = s.step AND x.value_id = k.value_id),
fold AS (SELECT step, value_id, greatest(0, least(1, d)) AS v FROM b WHERE step = 0 UNION ALL SELECT b.step, b.value_id, greatest(0, least(1, f.v + b.d)) FROM fold f JOIN b ON b.step = f.step + 1 AND b.value_id = f.value_id)
SELECT step, value_id FROM fold WHERE v = 1"""


@raw_query("g11", recursive(G11))
def g11(s: SparkSession, d: str) -> DataFrame:
    events = view(s, d, "vc").where("property_id = 31").select("step", "value_id", F.when(F.col("action") == "CREATE", 1).when(F.col("action") == "DELETE", -1).otherwise(0).alias("d"))
    return constraints.presence(events, view(s, d, "spine"), ["value_id"])


raw_query("g12", recursive(CLOSE.rstrip() + BAD + "SELECT entity_id, property_id FROM bad"))(violators)


@query(
    "g13",
    """WITH st AS (SELECT DISTINCT entity_id, property_id, CAST(substr(new_value, 2) AS BIGINT) AS target FROM vc WHERE property_id IN (31, 279) AND action <> 'DELETE')
SELECT a.property_id, CAST(count(*) AS DOUBLE) AS value FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.entity_id = a.target AND b.target = a.entity_id AND b.property_id = 310 - a.property_id) GROUP BY a.property_id""",
)
def g13(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "vc").where("property_id in (31, 279) and action <> 'DELETE'").select("entity_id", "property_id", values.qid_int(F.col("new_value")).cast("long").alias("target"))
    return constraints.inverse_violations(st, s.createDataFrame([(31, 279), (279, 31)], "property_id int, inverse_id int"))


@query(
    "f7",
    RUN
    + """, t AS (SELECT step, sum(value) AS v FROM r WHERE touched OR NOT anyone GROUP BY step), n AS (SELECT s.step, CAST(count(*) FILTER (WHERE action = 'CREATE') - count(*) FILTER (WHERE action = 'DELETE') AS DOUBLE) AS n
  FROM spine s JOIN vc v ON v.step <= s.step AND v.property_id IN (1081, 569) GROUP BY s.step) SELECT n.step, 1 - t.v / n.n AS value FROM n JOIN t ON t.step = n.step WHERE n.n <> 0""",
)
def f7(s: SparkSession, d: str) -> DataFrame:
    """Share of statements that violate no range constraint."""
    spine = view(s, d, "spine")
    bad = algebra.add(constraints.violation_counts(diffs(s, d), spine))
    all_ = algebra.add(counters.statements_of_properties(view(s, d, "vc"), spine, [1081, 569]))
    return algebra.complement(algebra.divide(bad, all_), spine)
