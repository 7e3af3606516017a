"""Queries of the revision diff, over revisions made from the events: one entity per user, one revision per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import extract
from tidemark.plans import adapter
from tidemark.plans.adapter import view
from tidemark.plans.registry import query

adapter.CTES |= {
    "rv": """SELECT event_id, us, user_id, event_type AS label, concat('Q', CAST(event_id % 3 AS STRING)) AS v, CASE WHEN event_id % 5 = 0 THEN 'preferred' ELSE 'normal' END AS rank, event_id % 4 AS ref, event_id % 2 AS link,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, lag(event_type) OVER w AS plabel, lag(concat('Q', CAST(event_id % 3 AS STRING))) OVER w AS pv,
  lag(CASE WHEN event_id % 5 = 0 THEN 'preferred' ELSE 'normal' END) OVER w AS prank, lag(event_id % 4) OVER w AS pref_, lag(event_id % 2) OVER w AS plink FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""",
}
adapter.ORDER[:] = list(adapter.CTES)


def revisions(s: SparkSession, d: str) -> DataFrame:
    ev = view(s, d, "ev")

    def text(x):
        return F.concat(F.lit('"'), x, F.lit('"'))

    def snak(kind: str, value):
        return F.concat(F.lit(f'{{"snaktype":"value","datavalue":{{"type":"{kind}","value":'), value, F.lit("}}"))

    q = F.concat(F.lit("Q"), (F.col("event_id") % 3).cast("string"))
    main = snak("wikibase-entityid", F.concat(F.lit('{"id":'), text(q), F.lit("}")))
    ref = snak("string", text(F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string"))))
    claim = F.concat(
        F.lit('{"claims":{"P31":[{"id":"s1","rank":'), text(F.when(F.col("event_id") % 5 == 0, "preferred").otherwise("normal")), F.lit(',"mainsnak":'), main,
        F.lit(',"references":[{"snaks":{"P854":['), ref, F.lit(']}}],"qualifiers":{"P580":['), ref, F.lit(']}}]},"labels":{"en":{"value":'), text(F.col("event_type")), F.lit('}},"sitelinks":'),
        F.when(F.col("event_id") % 2 == 0, F.lit('{"enwiki":{"title":"t"}}')).otherwise(F.lit("[]")), F.lit("}"),
    )
    return ev.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("revision_id"), F.timestamp_micros("us").alias("ts"), F.lit(False).alias("deleted"), claim.alias("text"))


def of_kind(s: SparkSession, d: str, kind: str) -> DataFrame:
    return extract.changes(revisions(s, d)).where(F.col("kind") == kind)


def value_sql(prop: int, col: str, before: str, created: str) -> str:
    return f"""SELECT event_id AS revision_id, CASE WHEN n = 1 THEN 'CREATE' ELSE 'UPDATE' END AS action, CASE WHEN n = 1 THEN '{created}' ELSE 'PROPERTY_VALUE' END AS target, concat('"', {col}, '"') AS new_value
FROM rv WHERE n = 1 OR {col} <> {before}"""


COLUMNS = ["revision_id", "action", "target", "new_value"]
query("b1", "SELECT event_id AS revision_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev_revision_id FROM rv WHERE n = 1 OR label <> plabel OR v <> pv OR rank <> prank OR ref <> pref_ OR link <> plink")(
    lambda s, d: of_kind(s, d, "revision").select("revision_id", "prev_revision_id")
)
query("b2", "SELECT count(DISTINCT user_id) AS entities, count(*) AS revisions FROM rv WHERE n = 1 OR label <> plabel OR v <> pv OR rank <> prank OR ref <> pref_ OR link <> plink")(
    lambda s, d: of_kind(s, d, "revision").agg(F.countDistinct("entity_id").alias("entities"), F.count("*").alias("revisions"))
)
query("b3", "SELECT event_id AS revision_id, user_id AS entity_id FROM rv WHERE n = 1")(
    lambda s, d: of_kind(s, d, "value").where("target = 'ENTITY' and action = 'CREATE'").select("revision_id", "entity_id")
)
query("b4", value_sql(-1, "label", "plabel", "PROPERTY"))(lambda s, d: of_kind(s, d, "value").where("property_id = -1").select(*COLUMNS))
query("b7", value_sql(31, "v", "pv", "ENTITY"))(lambda s, d: of_kind(s, d, "value").where("property_id = 31").select(*COLUMNS))
query("b8", "SELECT event_id AS revision_id, CASE WHEN n = 1 THEN 'CREATE' ELSE 'UPDATE' END AS action, concat('\"', rank, '\"') AS new_value FROM rv WHERE n = 1 OR rank <> prank")(
    lambda s, d: of_kind(s, d, "rank").select("revision_id", "action", "new_value")
)
SUB = """SELECT event_id AS revision_id, 'CREATE' AS action, concat('"r', CAST(ref AS STRING), '"') AS value FROM rv WHERE n = 1 OR ref <> pref_
UNION ALL SELECT event_id, 'DELETE', concat('"r', CAST(pref_ AS STRING), '"') FROM rv WHERE n > 1 AND ref <> pref_"""


def sub(s: SparkSession, d: str, kind: str) -> DataFrame:
    return of_kind(s, d, kind).select("revision_id", "action", F.when(F.col("action") == "CREATE", F.col("new_value")).otherwise(F.col("old_value")).alias("value"))


query("b9", SUB)(lambda s, d: sub(s, d, "qualifier"))
query("b10", SUB)(lambda s, d: sub(s, d, "reference"))
query(
    "b12",
    """SELECT event_id AS revision_id, CASE WHEN link = 0 THEN 'CREATE' ELSE 'DELETE' END AS action FROM rv WHERE (n = 1 AND link = 0) OR (n > 1 AND link <> plink)""",
)(lambda s, d: of_kind(s, d, "sitelink").select("revision_id", "action"))


RICH = """WITH r0 AS (SELECT event_id, user_id, us, event_id % 7 < 4 AS has, concat('+', CAST(event_id % 3 AS STRING)) AS amount, concat('Q', CAST(event_id % 2 AS STRING)) AS unit, 1 + event_id % 4 AS m, event_id % 3 AS g FROM ev),
r AS (SELECT *, row_number() OVER w AS n, coalesce(lag(has) OVER w, false) AS phas, lag(amount) OVER w AS pamount, lag(unit) OVER w AS punit, lag(m) OVER w AS pm, lag(g) OVER w AS pg FROM r0 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
"""


def rich_revisions(s: SparkSession, d: str) -> DataFrame:
    """Revisions in which a quantity (P7) comes and goes and changes its unit, and a time (P9) and a place (P10) are written in several ways."""
    ev, i = view(s, d, "ev"), F.col("event_id")
    snak = '{"snaktype":"value","datavalue":{"type":"%s","value":{%s}}}'
    amount = F.format_string('"amount":"+%d","unit":"http://www.wikidata.org/entity/Q%d"', i % 3, i % 2)
    time = F.format_string('"time":"+%s2013-%02d-01T00:00:00Z","before":%d', F.when(i % 2 == 0, "0000000").otherwise(""), 1 + i % 4, i % 2)
    place = F.format_string('"latitude":%d.5,"longitude":2,"altitude":null', i % 3)

    def claim(pid: str, kind: str, value, more=F.lit("")):
        head, tail = (snak % (kind, "\0")).split("\0")
        return F.concat(F.lit(f'"{pid}":[{{"id":"{pid}$1","rank":"normal","mainsnak":{head}'), value, F.lit(tail), more, F.lit("}]"))

    head, tail = (snak % ("time", "\0")).split("\0")
    qualifier = F.concat(F.lit(',"qualifiers":{"P580":[' + head), time, F.lit(tail + "]}"))
    claims = F.concat_ws(",", F.when(i % 7 < 4, claim("P7", "quantity", amount)), claim("P9", "time", time, qualifier), claim("P10", "globecoordinate", place))
    return ev.select(F.col("user_id").alias("entity_id"), i.alias("revision_id"), F.timestamp_micros("us").alias("ts"), F.lit(False).alias("deleted"), F.concat(F.lit('{"claims":{'), claims, F.lit("}}")).alias("text"))


def rich(s: SparkSession, d: str, prop: int, *kinds: str) -> DataFrame:
    return extract.changes(rich_revisions(s, d)).where((F.col("property_id") == prop) & F.col("kind").isin(*kinds))


query(
    "b5",
    RICH
    + """SELECT event_id AS revision_id, 'value' AS kind, CASE WHEN n = 1 THEN 'ENTITY' ELSE 'PROPERTY' END AS target, concat('"', amount, '"') AS new_value FROM r WHERE has AND NOT phas
UNION ALL SELECT event_id, 'metadata', 'PROPERTY_DATATYPE_METADATA', concat('"', unit, '"') FROM r WHERE has AND NOT phas UNION ALL SELECT event_id, 'rank', 'RANK', '"normal"' FROM r WHERE has AND NOT phas""",
)(lambda s, d: rich(s, d, 7, "value", "metadata", "rank").where("action = 'CREATE'").select("revision_id", "kind", "target", "new_value"))
query(
    "b6",
    RICH
    + """SELECT event_id AS revision_id, 'value' AS kind, 'PROPERTY' AS target, concat('"', pamount, '"') AS old_value FROM r WHERE phas AND NOT has
UNION ALL SELECT event_id, 'metadata', 'PROPERTY_DATATYPE_METADATA', concat('"', punit, '"') FROM r WHERE phas AND NOT has UNION ALL SELECT event_id, 'rank', 'RANK', '"normal"' FROM r WHERE phas AND NOT has""",
)(lambda s, d: rich(s, d, 7, "value", "metadata", "rank").where("action = 'DELETE'").select("revision_id", "kind", "target", "old_value"))
query("b11", RICH + """SELECT event_id AS revision_id, 'unit' AS change_target, concat('"', punit, '"') AS old_value, concat('"', unit, '"') AS new_value FROM r WHERE has AND phas AND unit <> punit""")(
    lambda s, d: rich(s, d, 7, "metadata").where("action = 'UPDATE'").select("revision_id", "change_target", "old_value", "new_value")
)
query("b13", RICH + """SELECT event_id AS revision_id, concat('"+2013-0', CAST(m AS STRING), '-01T00:00:00Z"') AS new_value FROM r WHERE n = 1 OR m <> pm""")(
    lambda s, d: rich(s, d, 9, "value").select("revision_id", "new_value")
)
query("b14", RICH + "SELECT event_id AS revision_id, 'CREATE' AS action FROM r WHERE n = 1 OR m <> pm UNION ALL SELECT event_id, 'DELETE' FROM r WHERE n > 1 AND m <> pm")(
    lambda s, d: rich(s, d, 9, "qualifier").select("revision_id", "action")
)
query("b15", RICH + """SELECT event_id AS revision_id, concat('{"latitude":', CAST(g AS STRING), '.5,"longitude":2}') AS new_value, 'globecoordinate' AS new_datatype FROM r WHERE n = 1 OR g <> pg""")(
    lambda s, d: rich(s, d, 10, "value").select("revision_id", "new_value", "new_datatype")
)
query("b16", "SELECT revision_id, CAST(levenshtein(old_value, new_value) AS DOUBLE) AS size FROM vc WHERE datatype = 'wikibase-entityid'")(
    lambda s, d: view(s, d, "vc").where("datatype = 'wikibase-entityid'").select("revision_id", values.magnitude(F.col("datatype"), F.col("old_value"), F.col("new_value")).alias("size"))
)
HAV = "2 * 6371 * asin(sqrt(pow(sin(radians(<b> - <a>) / 2), 2) + cos(radians(<a>)) * cos(radians(<b>)) * pow(sin(radians(<d> - <c>) / 2), 2)))"
query("b17", "SELECT event_id, round(" + HAV.replace("<a>", "(event_id % 90)").replace("<b>", "(user_id % 90)").replace("<c>", "(event_id % 180)").replace("<d>", "(user_id % 180)") + ", 6) AS km FROM ev")(
    lambda s, d: view(s, d, "ev").select("event_id", F.round(values.haversine_km(F.col("event_id") % 90, F.col("event_id") % 180, F.col("user_id") % 90, F.col("user_id") % 180), 6).alias("km"))
)
query("b18", "SELECT event_id, CAST(datediff('day', DATE '1970-01-01', day) + 2440588 AS BIGINT) AS julian FROM ev")(
    lambda s, d: view(s, d, "ev").select("event_id", values.julian_day(F.year("day"), F.month("day"), F.day("day")).alias("julian"))
)
query("b19", "SELECT revision_id, CAST(substr(new_value, 2, 4) AS INT) AS year, CAST(substr(new_value, 7, 2) AS INT) AS month, CAST(substr(new_value, 10, 2) AS INT) AS day FROM vc WHERE datatype = 'time'")(
    lambda s, d: view(s, d, "vc").where("datatype = 'time'").select("revision_id", values.time_parts(F.col("new_value")).alias("p")).select("revision_id", "p.year", "p.month", "p.day")
)
