"""Queries of source trust: references, sessions, preferences, classifications, and the preference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import domains
from tidemark.operators import counters, graph, trust
from tidemark.operators.lineage import settled
from tidemark.plans import adapter
from tidemark.plans.adapter import ORIGIN, STEP_US, view
from tidemark.plans.registry import query

GAP = 2 * 86400 * 1000000
LAST = 9
MARKS = trust.discard_steps(10, 3, 9)  # 3, 6, 9

adapter.CTES |= {
    "rd": """SELECT *, regexp_extract(regexp_extract(reference, '://([^/?#:]+)', 1), '[^.]+[.][^.]+$') AS domain, CASE WHEN action = 'CREATE' THEN 1 ELSE -1 END AS sign FROM rc""",
    "ses0": "SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY statement ORDER BY us, revision_id) > 172800000000 THEN 1 ELSE 0 END AS isnew FROM rd",
    "ses": "SELECT *, CAST(sum(isnew) OVER (PARTITION BY statement ORDER BY us, revision_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ses0",
    "net": "SELECT statement, session, reference, domain, CAST(sum(sign) AS BIGINT) AS net FROM ses GROUP BY statement, session, reference, domain",
    "clo": """SELECT statement, session, count(*) AS edits, count(DISTINCT reference) AS refs, max(us) AS last_us,
  CAST(floor(CAST(max(us) + 172800000000 - 1704067200000000 AS DOUBLE) / 2.592e11) AS BIGINT) AS step FROM ses GROUP BY statement, session""",
    "pref": """SELECT c.step, o.domain AS src, n.domain AS dst, count(*) AS weight
  FROM (SELECT DISTINCT statement, session, domain FROM net WHERE net <= 0) o JOIN (SELECT DISTINCT statement, session, domain FROM net WHERE net > 0) n
  ON o.statement = n.statement AND o.session = n.session AND o.domain <> n.domain JOIN clo c ON c.statement = o.statement AND c.session = o.session GROUP BY c.step, o.domain, n.domain""",
    "ends": "SELECT step, src AS domain, weight AS o, 0 AS i FROM pref UNION ALL SELECT step, dst, 0, weight FROM pref",
    "flow": """SELECT s.step, e.domain, CAST(sum(e.o) AS BIGINT) AS out_weight, CAST(sum(e.i) AS BIGINT) AS in_weight FROM spine s JOIN ends e ON e.step <= s.step GROUP BY s.step, e.domain""",
    "dmove": """SELECT s.step, k.domain, CAST(coalesce(sum(r.sign), 0) AS BIGINT) AS d, CAST(count(CASE WHEN r.sign > 0 THEN 1 END) AS BIGINT) AS c FROM spine s CROSS JOIN (SELECT DISTINCT domain FROM rd) k
  LEFT JOIN rd r ON r.step = s.step AND r.domain = k.domain GROUP BY s.step, k.domain""",
    "dfold": """SELECT step, domain, CASE WHEN step IN (3, 6, 9) AND d <= 1 THEN 0 ELSE d END AS v, CASE WHEN step IN (3, 6, 9) AND d <= 1 THEN 0 ELSE c END AS c FROM dmove g WHERE step = 0
  UNION ALL SELECT g.step, g.domain, CASE WHEN g.step IN (3, 6, 9) AND f.v + g.d <= 1 THEN 0 ELSE f.v + g.d END, CASE WHEN g.step IN (3, 6, 9) AND f.v + g.d <= 1 THEN 0 ELSE f.c + g.c END
  FROM dfold f JOIN dmove g ON g.step = f.step + 1 AND g.domain = f.domain""",
    "mass": "SELECT step, domain, CAST(v AS DOUBLE) AS mass FROM dfold WHERE v <> 0",
    "tot": "SELECT s.step, CAST(sum(r.sign) AS DOUBLE) AS value FROM spine s JOIN rd r ON r.step <= s.step GROUP BY s.step",
    "sm": """SELECT f.step, f.domain, m.mass, CASE WHEN out_weight >= 0.6 * (out_weight + in_weight) THEN 'dominated' WHEN in_weight >= 0.6 * (out_weight + in_weight) THEN 'dominating' ELSE 'contested' END AS class
  FROM flow f JOIN mass m ON m.step = f.step AND m.domain = f.domain WHERE m.mass > 0 AND out_weight + in_weight > 0 AND out_weight + in_weight >= 0.05 * m.mass""",
    "edges": "SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM pref WHERE step <= 9 GROUP BY src, dst",
    "mass9": "SELECT domain, mass FROM mass WHERE step = 9",
}
adapter.ORDER[:] = list(adapter.CTES)


def refs(s: SparkSession, d: str) -> DataFrame:
    return trust.edit_stream(domains.with_domain(view(s, d, "rc")))


def sessions(s: SparkSession, d: str) -> DataFrame:
    return trust.sessionize(refs(s, d), GAP)


def closes(s: SparkSession, d: str) -> DataFrame:
    return trust.session_close(sessions(s, d), GAP, ORIGIN, STEP_US)


def prefs_of(r: DataFrame) -> DataFrame:
    x = settled(trust.sessionize(r, GAP))
    return trust.preferences(trust.session_net(x), trust.session_close(x, GAP, ORIGIN, STEP_US))


def prefs(s: SparkSession, d: str) -> DataFrame:
    return prefs_of(refs(s, d))


def spine(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "spine")


def counts_of(r: DataFrame, spine: DataFrame) -> DataFrame:
    return trust.domain_counts(r.select("step", "domain", F.col("sign").cast("long").alias("d"), (F.col("sign") > 0).cast("long").alias("c")), spine, MARKS)


def mass_of(counts: DataFrame) -> DataFrame:
    """Net references of each domain, without those that were discarded."""
    return counts.where("count <> 0").select("step", "domain", F.col("count").cast("double").alias("mass"))


def mass(s: SparkSession, d: str) -> DataFrame:
    return mass_of(counts_of(refs(s, d), spine(s, d)))


def mass9(s: SparkSession, d: str) -> DataFrame:
    return mass(s, d).where(F.col("step") == LAST).select("domain", "mass")


def edges(s: SparkSession, d: str) -> DataFrame:
    return settled(graph.edges_at(prefs(s, d), LAST))


@query("h1", "SELECT revision_id, replace(trim(coalesce(reference, ''), '\"'), ' ', '%20') AS reference FROM rc")
def h1(s, d):
    return view(s, d, "rc").select("revision_id", domains.normalize_reference(F.col("reference")).alias("reference"))


@query("h2", "SELECT revision_id, reference FROM rc WHERE regexp_matches(reference, '^(Q|http|www|ISBN|PMID|DOI)')")
def h2(s, d):
    return view(s, d, "rc").where(domains.counts(F.col("reference"))).select("revision_id", "reference")


@query("h3", "SELECT DISTINCT reference, regexp_extract(regexp_extract(reference, '://([^/?#:]+)', 1), '[^.]+[.][^.]+$') AS domain FROM rc")
def h3(s, d):
    return domains.with_domain(view(s, d, "rc").select("reference").distinct()).select("reference", "domain")


def raw_query(name: str, sql: str):
    from tidemark.plans import registry

    def register(f):
        registry._queries[name] = f
        registry._sql[name] = sql
        return f

    return register


def kept(s: SparkSession, d: str) -> DataFrame:
    return counts_of(refs(s, d), spine(s, d)).where("count <> 0").select("step", "domain", "count")


def totals(s: SparkSession, d: str) -> DataFrame:
    return counters.created_less_deleted(refs(s, d), spine(s, d))


query("h4", "SELECT step, domain, v AS count FROM dfold WHERE v <> 0")(kept)
query("h5", "SELECT f.step, f.domain, f.v AS count, f.v / t.value AS fraction FROM dfold f JOIN tot t ON t.step = f.step WHERE f.v <> 0")(lambda s, d: trust.domain_fractions(kept(s, d), totals(s, d)))
query(
    "h5_tail",
    """SELECT t.step, t.value AS total, t.value - coalesce(h.held, 0) AS tail, (t.value - coalesce(h.held, 0)) / t.value AS tail_fraction
FROM tot t LEFT JOIN (SELECT step, CAST(sum(v) AS DOUBLE) AS held FROM dfold GROUP BY step) h ON h.step = t.step""",
)(lambda s, d: trust.tail(kept(s, d), totals(s, d)))
query("h6", "SELECT statement, us, revision_id, reference, sign FROM rd")(lambda s, d: refs(s, d).select("statement", "us", "revision_id", "reference", "sign"))
query("h7", "SELECT revision_id, statement, session FROM ses")(lambda s, d: sessions(s, d).select("revision_id", "statement", "session"))
query("h8", "SELECT * FROM net")(lambda s, d: trust.session_net(sessions(s, d)))
query("h9", "SELECT statement, session, edits, last_us, step FROM clo")(lambda s, d: closes(s, d).drop("references"))
query("h10", "SELECT * FROM pref")(prefs)
query(
    "h11_stats",
    """WITH b AS (SELECT s.step, count(c.statement) AS closed, coalesce(sum(c.edits), 0) AS e, coalesce(sum(c.refs), 0) AS r FROM spine s LEFT JOIN clo c ON c.step = s.step GROUP BY s.step)
SELECT step, closed, CAST(sum(closed) OVER w AS BIGINT) AS closed_total, e / nullif(closed, 0) AS avg_size, sum(e) OVER w / nullif(sum(closed) OVER w, 0) AS avg_size_total, r / nullif(closed, 0) AS avg_references
FROM b WINDOW w AS (ORDER BY step)""",
)(lambda s, d: trust.session_stats(closes(s, d), spine(s, d)))
query("h11", "SELECT * FROM flow")(lambda s, d: trust.flows(prefs(s, d), spine(s, d)))


def flow_and_counts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Flows, and counts per domain; what both read is settled once."""
    r = settled(refs(s, d).select("statement", "us", "revision_id", "reference", "domain", "sign", "step"))
    return trust.flows(prefs_of(r), spine(s, d)), settled(counts_of(r, spine(s, d)))


def classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Classes by supermajority, and the masses."""
    flow, counts = flow_and_counts(s, d)
    return trust.supermajority(flow, mass_of(counts)), mass_of(counts)


query("h12", "SELECT * FROM sm")(lambda s, d: classes(s, d)[0])
query(
    "h12_fractions",
    """WITH t AS (SELECT step, sum(mass) AS total FROM mass GROUP BY step), b AS (SELECT sm.step, class, CASE WHEN max(t.total) > 0 THEN sum(mass) / max(t.total) ELSE 0 END AS fraction FROM sm JOIN t ON t.step = sm.step GROUP BY sm.step, class)
SELECT * FROM b UNION ALL SELECT t.step, 'unclassified', greatest(0, 1 - coalesce((SELECT sum(fraction) FROM b WHERE b.step = t.step), 0)) FROM t""",
)(lambda s, d: trust.class_fractions(*classes(s, d)))
query(
    "h13",
    """SELECT m.step, m.domain, m.mass, CAST(m.rank AS INT) AS rank, CASE sm.class WHEN 'dominated' THEN -1 WHEN 'contested' THEN 0 WHEN 'dominating' THEN 1 ELSE 2 END AS class_value
FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY mass DESC, domain) AS rank FROM mass) m LEFT JOIN sm ON sm.step = m.step AND sm.domain = m.domain WHERE m.rank <= 10""",
)(lambda s, d: trust.top_classes(*classes(s, d), 10))

W = """low_high AS (SELECT *, out_weight / deff AS k, (out_weight + in_weight) / deff AS n, 1.645e0 * 1.645e0 AS z2 FROM x),
w AS (SELECT *, k / n AS p FROM low_high),
w2 AS (SELECT *, (p + z2 / (2 * n)) AS c, 1.645e0 * sqrt((p * (1 - p) + z2 / (4 * n)) / n) AS s FROM w),
w3 AS (SELECT *, greatest((c - s) / (1 + z2 / n), 0) AS low, least((c + s) / (1 + z2 / n), 1) AS high FROM w2)
"""
H15 = (
    """WITH v AS (SELECT f.*, greatest(coalesce(m.v, 0), 0) AS held, coalesce(m.v, 0) AS mass, coalesce(m.c, 0) AS creates FROM flow f LEFT JOIN dfold m ON m.step = f.step AND m.domain = f.domain WHERE out_weight + in_weight > 0),
y AS (SELECT *, 1 + ln(1 + held / 1000.0e0) AS deff, CASE WHEN sum(held) OVER q > 0 THEN held / CAST(sum(held) OVER q AS DOUBLE) ELSE 0 END + 1.0e0 / count(*) OVER q AS ms,
  CASE WHEN sum(creates) OVER q > 0 THEN creates / CAST(sum(creates) OVER q AS DOUBLE) ELSE 0 END + 1.0e0 / count(*) OVER q AS cs FROM v WINDOW q AS (PARTITION BY step)),
z AS (SELECT *, greatest(0.02e0, least(0.98e0, ms / (ms + cs))) AS p0 FROM y),
x AS (SELECT *, greatest(p0 * 0.7e0 / (p0 * 0.7e0 + (1 - p0) * 0.3e0), 0.7e0) AS bar FROM z),
"""
    + W
)


def wilson_classes(s: SparkSession, d: str) -> DataFrame:
    flow, counts = flow_and_counts(s, d)
    return trust.flow_wilson(flow, mass_of(counts), counts.select("step", "domain", "creates"))


query("h14", H15 + "SELECT step, domain, round(low, 9) AS low, round(high, 9) AS high FROM w3")(lambda s, d: wilson_classes(s, d).select("step", "domain", F.round("low", 9).alias("low"), F.round("high", 9).alias("high")))
query(
    "h15",
    H15 + "SELECT step, domain, round(p0, 9) AS p0, round(bar, 9) AS bar, CASE WHEN high <= 1 - 0.7e0 THEN 'dominating' WHEN low >= bar THEN 'dominated' ELSE 'contested' END AS class FROM w3",
)(lambda s, d: wilson_classes(s, d).select("step", "domain", F.round("p0", 9).alias("p0"), F.round("bar", 9).alias("bar"), "class"))
query(
    "h15_diagnostics",
    H15
    + """SELECT step, round(median(deff), 9) AS median_deff, round(sum(mass * deff) / nullif(sum(mass), 0), 9) AS mean_deff, round(sum(mass * (high - low)) / nullif(sum(mass), 0), 9) AS mean_width,
count(CASE WHEN bar > 0.7e0 THEN 1 END) AS raised FROM w3 GROUP BY step""",
)(lambda s, d: trust.wilson_diagnostics(wilson_classes(s, d)).select("step", *(F.round(c, 9).alias(c) for c in ("median_deff", "mean_deff", "mean_width")), "raised"))
query("h16", "SELECT step, domain, c AS count FROM dfold WHERE c <> 0")(
    lambda s, d: counts_of(refs(s, d), spine(s, d)).where("creates <> 0").select("step", "domain", F.col("creates").alias("count"))
)
query(
    "h17",
    """WITH fe AS (SELECT src, dst, min(step) AS step FROM pref GROUP BY src, dst), fv AS (SELECT v, min(step) AS step FROM (SELECT src AS v, step FROM pref UNION ALL SELECT dst, step FROM pref) GROUP BY v),
n AS (SELECT s.step, (SELECT count(*) FROM fv WHERE fv.step <= s.step) AS vertices, (SELECT count(*) FROM fe WHERE fe.step <= s.step) AS edges, (SELECT count(*) FROM fe WHERE fe.step = s.step) AS new_edges FROM spine s)
SELECT *, coalesce(edges / nullif(vertices * (vertices - 1), 0), 0) AS density, coalesce(edges / nullif(vertices, 0), 0) AS average_degree, max(edges) OVER (ORDER BY step) AS max_edges FROM n""",
)(lambda s, d: graph.graph_series(prefs(s, d), spine(s, d)))
query(
    "h18",
    """SELECT src, dst, weight FROM edges WHERE src IN (SELECT domain FROM mass9 WHERE mass >= 20) AND dst IN (SELECT domain FROM mass9 WHERE mass >= 20)""",
)(lambda s, d: graph.without_low_mass(edges(s, d), mass9(s, d), 20, 10))

ACCEPTED = """WITH o AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS k, count(*) OVER () AS n FROM edges), cut AS (SELECT weight AS c FROM o WHERE k = CAST(ceil(0.3e0 * n) AS BIGINT) - 1),
acc AS (SELECT e.src, e.dst, e.weight FROM edges e LEFT JOIN edges r ON r.src = e.dst AND r.dst = e.src CROSS JOIN cut WHERE e.weight > cut.c AND e.weight >= 0.8 * coalesce(r.weight, 0))
"""
query("h19", ACCEPTED + "SELECT * FROM acc")(lambda s, d: graph.accepted_edges(edges(s, d), 0.3))
query(
    "h20",
    """WITH w AS (SELECT domain, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM ends WHERE step <= 9 GROUP BY domain)
SELECT w.domain, CASE WHEN o >= 0.7 * (o + i) THEN 'dominated' WHEN i >= 0.7 * (o + i) THEN 'dominating' ELSE 'contested' END AS class FROM w JOIN mass9 m ON m.domain = w.domain WHERE mass > 0 AND o + i > 0 AND o + i >= 0.01 * mass""",
)(lambda s, d: graph.weight_flow(edges(s, d), mass9(s, d)))
DEGREE = """,
deg AS (SELECT domain, CASE WHEN sum(o) = 0 THEN 'dominating' WHEN sum(i) = 0 THEN 'dominated' ELSE 'contested' END AS class FROM (SELECT src AS domain, 1 AS o, 0 AS i FROM acc UNION ALL SELECT dst, 0, 1 FROM acc) GROUP BY domain)"""
query("h21", ACCEPTED.rstrip() + DEGREE + "\nSELECT * FROM deg")(lambda s, d: graph.simple_degree(graph.accepted_edges(edges(s, d), 0.3)))
query(
    "h22",
    ACCEPTED.rstrip()
    + DEGREE
    + """,
r0 AS (SELECT src AS origin, dst AS start, dst AS pos FROM acc), r1 AS (SELECT DISTINCT origin, start, a.dst AS pos FROM r0 JOIN acc a ON a.src = r0.pos), r2 AS (SELECT DISTINCT origin, start, a.dst AS pos FROM r1 JOIN acc a ON a.src = r1.pos),
r3 AS (SELECT DISTINCT origin, start, a.dst AS pos FROM r2 JOIN acc a ON a.src = r2.pos), back AS (SELECT origin, start FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE pos = origin),
lost AS (SELECT DISTINCT src FROM acc WHERE (src, dst) NOT IN (SELECT (origin, start) FROM back))
SELECT domain, CASE WHEN class = 'contested' AND domain IN (SELECT src FROM lost) THEN 'dominated' ELSE class END AS class FROM deg""",
)(lambda s, d: graph.degree_with_path(graph.accepted_edges(edges(s, d), 0.3)))
query(
    "h23",
    ACCEPTED.rstrip()
    + DEGREE
    + """,
v AS (SELECT src AS domain FROM edges UNION SELECT dst FROM edges)
SELECT coalesce(deg.class, CASE WHEN v.domain IS NULL THEN 'not_in_graph' ELSE 'unclassified' END) AS class, sum(mass) / (SELECT sum(mass) FROM mass9) AS fraction
FROM mass9 m LEFT JOIN v ON v.domain = m.domain LEFT JOIN deg ON deg.domain = m.domain GROUP BY 1""",
)(lambda s, d: graph.class_mass(graph.simple_degree(graph.accepted_edges(edges(s, d), 0.3)), edges(s, d), mass9(s, d)))
query("h24")(lambda s, d: graph.replacements(refs(s, d), 86400 * 1000000))


OLDEST = """WITH ce AS (SELECT CASE WHEN src IN (SELECT domain FROM mass9 WHERE mass >= 40) THEN src ELSE '(contracted)' END AS src, CASE WHEN dst IN (SELECT domain FROM mass9 WHERE mass >= 40) THEN dst ELSE '(contracted)' END AS dst,
  CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY 1, 2),
o AS (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS k, count(*) OVER () AS n FROM ce), cut AS (SELECT weight AS c FROM o WHERE k = CAST(floor(0.3e0 * n) AS BIGINT)),
acc AS (SELECT e.src, e.dst, e.weight FROM ce e LEFT JOIN ce r ON r.src = e.dst AND r.dst = e.src CROSS JOIN cut WHERE e.weight >= cut.c AND e.weight > 0.8e0 * coalesce(r.weight, 0))
"""
WALKS = "".join(f",\nr{k} AS (SELECT DISTINCT origin, start, a.dst AS pos FROM r{k - 1} JOIN acc a ON a.src = r{k - 1}.pos)" for k in range(1, 6))


@query(
    "h25",
    OLDEST.rstrip()
    + DEGREE
    + ",\nr0 AS (SELECT src AS origin, dst AS start, dst AS pos FROM acc)"
    + WALKS
    + """,
back AS (SELECT origin, start FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) WHERE pos = origin),
lost AS (SELECT DISTINCT src FROM acc WHERE (src, dst) NOT IN (SELECT (origin, start) FROM back))
SELECT domain, CASE WHEN class = 'contested' AND domain IN (SELECT src FROM lost) THEN 'dominated' ELSE class END AS class FROM deg""",
)
def h25(s: SparkSession, d: str) -> DataFrame:
    """The oldest classifier: domains of low mass made one, older cutoffs, paths of up to five edges."""
    r = settled(refs(s, d).select("statement", "us", "revision_id", "reference", "domain", "sign", "step"))
    m = mass_of(counts_of(r, spine(s, d))).where(F.col("step") == LAST).select("domain", "mass")
    e = settled(graph.contracted(settled(graph.edges_at(prefs_of(r), LAST)), m, 40, 1))
    return graph.degree_with_path(graph.accepted_edges(e, 0.3, strict=False), 5)


query(
    "j19",
    """SELECT e.src, e.dst, e.weight, coalesce(r.weight, 0) AS reverse, e.weight - coalesce(r.weight, 0) AS net FROM edges e LEFT JOIN edges r ON r.src = e.dst AND r.dst = e.src
WHERE e.src = (SELECT min(src) FROM edges) ORDER BY e.weight DESC, e.dst LIMIT 5""",
)(lambda s, d: graph.neighbours(edges(s, d), edges(s, d).agg(F.min("src")).first()[0] or "", 5))


@query(
    "j20",
    """WITH f AS (SELECT out_weight + in_weight AS w, mass FROM flow JOIN mass9 ON mass9.domain = flow.domain WHERE step = 9), grid AS (SELECT * FROM (VALUES (0.01e0), (0.05e0), (0.1e0)) t(threshold) CROSS JOIN (VALUES (5.0e0), (1000.0e0)) c(cap))
SELECT threshold, cap, count(CASE WHEN w >= least(threshold * mass, cap) THEN 1 END) AS domains, coalesce(sum(CASE WHEN w >= least(threshold * mass, cap) THEN mass END), 0) AS mass FROM grid CROSS JOIN f GROUP BY threshold, cap""",
)
def j20(s: SparkSession, d: str) -> DataFrame:
    """Domains and mass that pass each guard of a grid of (threshold, cap)."""
    flow, counts = flow_and_counts(s, d)
    rows = flow.where(F.col("step") == LAST).join(mass_of(counts).where(F.col("step") == LAST).drop("step"), "domain")
    grid = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(cap).alias("cap")) for t in (0.01, 0.05, 0.1) for cap in (5.0, 1000.0)))  # small and fixed
    each = rows.withColumn("g", F.explode(grid)).select("g.*", "mass", (F.col("out_weight") + F.col("in_weight") >= F.least(F.col("g.threshold") * F.col("mass"), F.col("g.cap"))).alias("ok"))
    return each.groupBy("threshold", "cap").agg(F.count_if("ok").alias("domains"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("mass"))), F.lit(0.0)).alias("mass"))


query(
    "j21",
    "SELECT v.domain, coalesce(m.mass, 0) AS mass, coalesce(m.mass, 0) / (SELECT sum(mass) FROM mass9) AS fraction FROM (SELECT src AS domain FROM edges UNION SELECT dst FROM edges) v LEFT JOIN mass9 m ON m.domain = v.domain",
)(
    lambda s, d: edges(s, d)
    .select(F.explode(F.array("src", "dst")).alias("domain"))
    .distinct()
    .join(mass9(s, d), "domain", "left")
    .select("domain", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.try_divide(F.coalesce("mass", F.lit(0.0)), mass9(s, d).agg(F.sum("mass")).scalar()).alias("fraction"))
)
