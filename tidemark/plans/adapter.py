"""Views of the driver's tables in the change-log schema, in SQL that Spark and DuckDB both read.

A step is three days from 2024-01-01. Each view is a CTE; ``sql`` puts the ones that a query
names in front of it, for either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ORIGIN = 1704067200000000
STEP_US = 259200000000
MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}

CTES = {
    "ev": """SELECT event_id, <us> AS us, CAST(floor(CAST(<us> - 1704067200000000 AS DOUBLE) / 2.592e11) AS BIGINT) AS step,
  CAST(ts AS DATE) AS day, user_id, event_type, value, user_id * 10 + event_id % 10 AS entity_id FROM events""",
    "ev2": """SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, event_id) AS rn,
  CASE event_type WHEN 'click' THEN 31 WHEN 'view' THEN 279 WHEN 'purchase' THEN 569 WHEN 'signup' THEN -1 ELSE 1081 END AS property_id,
  CASE event_type WHEN 'purchase' THEN 'time' WHEN 'error' THEN 'quantity' WHEN 'signup' THEN 'string' ELSE 'wikibase-entityid' END AS datatype,
  CASE event_type WHEN 'purchase' THEN concat('+', CAST(day - CAST(event_id % 120 AS INT) AS STRING), 'T00:00:00Z')
    WHEN 'error' THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) WHEN 'signup' THEN 'text'
    ELSE concat('Q', CAST(event_id % 25 AS STRING)) END AS new_value,
  concat(CAST(entity_id AS STRING), '$', event_type, '$', CAST(event_id % 20 AS STRING)) AS value_id FROM ev""",
    "vc": """SELECT event_id AS revision_id, entity_id, us, step, property_id, value_id, datatype, new_value,
  coalesce(lag(new_value) OVER (PARTITION BY value_id ORDER BY us, event_id), '{}') AS old_value,
  CASE WHEN rn = 1 THEN 'CREATE' WHEN event_id % 4 = 3 THEN 'DELETE' WHEN event_id % 4 = 2 THEN 'UPDATE' ELSE 'CREATE' END AS action,
  CASE WHEN rn = 1 THEN 'ENTITY' WHEN event_id % 2 = 0 THEN 'PROPERTY' ELSE 'PROPERTY_VALUE' END AS target, '' AS change_target FROM ev2""",
    "npages": "SELECT count(*) AS n FROM pages",
    "ev3": "SELECT *, event_id % (SELECT n FROM npages) AS page_id FROM ev2",
    "rc": """SELECT e.event_id AS revision_id, e.entity_id, e.us, e.step, e.property_id,
  concat(CAST(e.user_id AS STRING), '_', CAST(e.property_id AS STRING), '_', CAST(e.user_id % 7 AS STRING)) AS statement, e.value_id, p.url AS reference,
  CASE WHEN e.event_id % 4 = 3 THEN 'DELETE' ELSE 'CREATE' END AS action, '' AS change_target
  FROM ev3 e JOIN pages p ON p.page_id = e.page_id""",
    "spine": """SELECT CAST(s AS BIGINT) AS step FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) t(s)""",
    "et": "SELECT DISTINCT entity_id, CAST(entity_id % 25 AS BIGINT) AS class_id FROM ev",
    "sc": """SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS entity_id, CAST(100 + n_regionkey AS BIGINT) AS class_id FROM nation
  UNION SELECT CAST(100 + r_regionkey AS BIGINT), CAST(200 AS BIGINT) FROM region""",
    "es": """SELECT * FROM (VALUES (1, 31, 1, CAST(NULL AS INT), 'entity'), (1, 569, CAST(NULL AS INT), 2, 'time'), (2, 279, 0, 3, 'some'), (1, 279, 0, 3, CAST(NULL AS STRING)), (1, -1, 0, 1, 'english'), (3, -1, 0, CAST(NULL AS INT), 'german'),
  (2, 31, 1, 1, 'entity'), (3, 1081, 0, 1, 'number'), (3, 569, 1, CAST(NULL AS INT), 'time')) t(entity_schema_id, property_id, min, max, value_constraint)""",
    "scm": "SELECT CAST(n_nationkey AS BIGINT) AS class_id, CAST(1 + n_nationkey % 3 AS INT) AS entity_schema_id FROM nation",
}
ORDER = list(CTES)
RECURSIVE = {"dfold"}


def sql(text: str, engine: str) -> str:
    """text with the CTEs that it needs before it."""
    need, todo = set(), [text]
    while todo:
        t = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", t):
                need.add(name)
                todo.append(CTES[name])
    if not need:
        return text
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in ORDER if n in need).replace("<us>", MICROS[engine])
    body, begin = text.strip(), "WITH RECURSIVE" if need & RECURSIVE else "WITH"
    if body[:5].upper() == "WITH ":
        return f"{begin} {ctes},\n{body[5:]}"
    return f"{begin} {ctes}\n{body}"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


SOURCES = {"ev": "events", "vc": "events", "et": "events", "rc": "events pages", "sc": "nation region", "scm": "nation", "spine": "", "es": ""}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    tables(spark, sf_dir, *SOURCES[name].split())
    return spark.sql(sql(f"SELECT * FROM {name}", "spark"))
