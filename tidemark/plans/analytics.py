"""Queries of the analytics over result series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analytics, counters
from tidemark.plans import adapter, trust
from tidemark.plans import schema as schema_plans
from tidemark.plans.adapter import view
from tidemark.plans.registry import query

adapter.CTES |= {
    "ser": """SELECT s.step, v.property_id, CAST(count(*) AS DOUBLE) AS value FROM spine s JOIN vc v ON v.step <= s.step WHERE v.action = 'CREATE' GROUP BY s.step, v.property_id""",
    "dom": "SELECT domain, mass FROM mass WHERE step = 9",
}
adapter.ORDER[:] = list(adapter.CTES)


def ser(s: SparkSession, d: str) -> DataFrame:
    """Creations so far per property."""
    diffs = counters.step_diffs(view(s, d, "vc").where("action = 'CREATE'"), F.count("*"), ["property_id"])
    return counters.running(diffs, view(s, d, "spine"), ["property_id"])


def named(s: SparkSession, d: str) -> DataFrame:
    return ser(s, d).withColumn("metric", F.concat(F.lit("count_p"), F.col("property_id").cast("string"))).withColumn("run_id", F.lit(1))


def cls(s: SparkSession, d: str) -> DataFrame:
    return trust.classes(s, d)[0]


query("j1", "SELECT step, property_id, value FROM ser WHERE property_id IN (31, 569)")(
    lambda s, d: analytics.fetch_series(named(s, d), 1, ["count_p31", "count_p569"], "property_id", [31, 569]).select("step", "property_id", "value")
)
query("j2", "SELECT step, sum(value) AS value FROM ser WHERE property_id IN (31, 569) GROUP BY step")(lambda s, d: analytics.fetch_aggregated(ser(s, d), "property_id", [31, 569]))
query("j4")(lambda s, d: analytics.spikes(named(s, d).withColumn("value", F.abs(F.sin("value"))), 2, 0.2).select("metric", "step", "prominence", "direction"))
query("j5", "SELECT DISTINCT concat('count_p', CAST(property_id AS STRING)) AS metric FROM ser")(
    lambda s, d: analytics.run_metrics(named(s, d).select("metric").distinct().unionByName(s.createDataFrame([("never_written",)], "metric string")), named(s, d))
)
query("j6", "SELECT property_id, count(*) AS n, min(step) AS first, max(step) AS last FROM ser GROUP BY property_id")(lambda s, d: analytics.written(ser(s, d), "property_id"))
query("j7", "SELECT property_id, value, value / sum(value) OVER () AS share FROM ser WHERE step = 7")(lambda s, d: analytics.latest(ser(s, d), 7, "property_id"))
query("j8", f"SELECT property_id, CAST(sum(statements - late - future) AS BIGINT) AS current, CAST(sum(late) AS BIGINT) AS late, CAST(sum(future) AS BIGINT) AS future, avg(eligible / statements) AS eligible_share FROM ({schema_plans.E5}) x GROUP BY property_id")(
    lambda s, d: analytics.age_inspection(schema_plans.age.age_scores(schema_plans.alive(s, d)))
)


def two_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = ser(s, d)
    return x.where("property_id = 31").drop("property_id"), x.where("property_id = 279").drop("property_id")


J9 = "SELECT a.step, a.value, b.value AS other, b.value - a.value AS diff, (b.value - a.value) / a.value AS relative FROM ser a JOIN ser b ON a.step = b.step WHERE a.property_id = 31 AND b.property_id = 279"
query("j9", J9)(lambda s, d: analytics.compare_runs(*two_runs(s, d)))
query("j9_summary", f"SELECT count(*) AS n, avg(diff) AS mean, avg(abs(diff)) AS mean_abs, max(abs(diff)) AS max_abs FROM ({J9}) x")(lambda s, d: analytics.comparison_summary(analytics.compare_runs(*two_runs(s, d))))
OUT = "('blog.ththed.example.com', 'm.ththth.example.net')"
query("j10", f"SELECT step, class, sum(CASE WHEN domain IN {OUT} THEN 0 ELSE mass END) / (sum(sum(CASE WHEN domain IN {OUT} THEN 0 ELSE mass END)) OVER (PARTITION BY step)) AS fraction FROM sm GROUP BY step, class")(
    lambda s, d: analytics.fractions_without(cls(s, d), ["blog.ththed.example.com", "m.ththth.example.net"])
)
query("j11", "SELECT step, class, count(*) AS n, sum(mass) AS mass, sum(mass) / (sum(sum(mass)) OVER (PARTITION BY step)) AS coverage FROM sm GROUP BY step, class")(lambda s, d: analytics.top_counts(cls(s, d)))
query("j12", "SELECT step, domain, mass, class FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY step DESC) AS r FROM sm) x WHERE r = 1")(lambda s, d: analytics.end_state(cls(s, d)))
query(
    "j13",
    """SELECT domain, count(*) FILTER (WHERE class = 'dominated') AS dominated, count(*) FILTER (WHERE class = 'contested') AS contested, count(*) FILTER (WHERE class = 'dominating') AS dominating,
CAST(sum(CASE WHEN p <> class THEN 1 ELSE 0 END) AS BIGINT) AS switches, arg_min(class, step) AS first, arg_max(class, step) AS last FROM (SELECT *, lag(class) OVER (PARTITION BY domain ORDER BY step) AS p FROM sm) x GROUP BY domain""",
)(lambda s, d: analytics.stability(cls(s, d)))
query("j14", "SELECT step, class, domain, mass, CAST(rank AS INT) AS rank, share FROM (SELECT *, row_number() OVER w AS rank, mass / sum(mass) OVER (PARTITION BY step, class) AS share FROM sm WHERE step IN (3, 9) WINDOW w AS (PARTITION BY step, class ORDER BY mass DESC, domain)) x WHERE rank <= 3")(
    lambda s, d: analytics.top_k(analytics.nearest(cls(s, d), s.createDataFrame([(3,), (10,)], "target long"), 1).drop("target"), 3, ["step", "class"])
)
query("j15", "SELECT domain, mass, share, sum(share) OVER (ORDER BY mass DESC, domain) AS cumulative, CAST(rank AS INT) AS rank FROM (SELECT *, mass / sum(mass) OVER () AS share, row_number() OVER (ORDER BY mass DESC, domain) AS rank FROM dom) x WHERE rank <= 10")(
    lambda s, d: analytics.top_overall(trust.mass9(s, d), 10)
)
query("j16", "SELECT property_id, arg_max(value, step) FILTER (WHERE step <= 6) AS as_of, arg_min(value, step) AS first, min(value) AS min, max(value) AS max, avg(value) AS mean, count(*) AS n FROM ser GROUP BY property_id")(
    lambda s, d: analytics.stats_summary(ser(s, d), ["property_id"], 6)
)
query("j17", "SELECT coalesce(a.class, 'unclassified') AS class_a, coalesce(b.class, 'unclassified') AS class_b, count(*) AS domains FROM (SELECT * FROM sm WHERE step = 3) a FULL JOIN (SELECT * FROM sm WHERE step = 9) b ON a.domain = b.domain GROUP BY 1, 2")(
    lambda s, d: analytics.compare_classifiers(cls(s, d).where("step = 3"), cls(s, d).where("step = 9"))
)
query("j18", "SELECT step, sum(CASE WHEN domain = 'example.org' THEN mass ELSE 0 END) AS mass, sum(CASE WHEN domain = 'example.org' THEN mass ELSE 0 END) / sum(mass) AS share FROM mass GROUP BY step")(
    lambda s, d: analytics.group_share(trust.mass(s, d), suffixes=["example.org"])
)
query("j22", "SELECT a.step, a.value AS a, b.value AS b FROM ser a JOIN ser b ON a.step = b.step WHERE a.property_id = 31 AND b.property_id = 279 AND a.step < 8")(
    lambda s, d: analytics.runtimes_aligned(*(x.withColumnRenamed("value", "seconds") for x in two_runs(s, d)), drop_last=2)
)
query("j23", "SELECT a.step, a.value + b.value AS process_mb, a.value AS database_mb, b.value AS other_mb FROM ser a JOIN ser b ON a.step = b.step WHERE a.property_id = 31 AND b.property_id = 279")(
    lambda s, d: analytics.memory_profile(two_runs(s, d)[0].join(two_runs(s, d)[1].withColumnRenamed("value", "o"), "step").select("step", (F.col("value") + F.col("o")).alias("process_mb"), F.col("value").alias("database_mb")))
)
query("j24", "SELECT step, substr(CAST(abs(property_id) AS STRING), 1, 1) AS setting, concat('count_p', CAST(property_id AS STRING)) AS metric, value / sum(value) OVER (PARTITION BY step, substr(CAST(abs(property_id) AS STRING), 1, 1)) AS fraction FROM ser")(
    lambda s, d: analytics.mass_fractions(named(s, d), r"count_p-?(\d)")
)
query("j25", "SELECT block, class, domain, mass, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block, class ORDER BY mass DESC, domain) AS rank FROM (SELECT CAST(floor(step / 5) AS BIGINT) AS block, class, domain, sum(mass) / 5 AS mass FROM sm GROUP BY 1, 2, 3) y) x WHERE rank <= 2")(
    lambda s, d: analytics.top_blocks(cls(s, d), 5, 2)
)
query("i_nearest", "SELECT t.target, s.step, s.value FROM (VALUES (2, 2), (11, 9)) t(target, step) JOIN ser s ON s.step = t.step AND s.property_id = 31")(
    lambda s, d: analytics.nearest(ser(s, d).where("property_id = 31"), s.createDataFrame([(2,), (11,), (40,)], "target int"), 2).select("target", "step", "value")
)
