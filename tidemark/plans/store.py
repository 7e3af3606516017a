"""Queries of sources, sinks and the result store, and of the streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import analytics as series_plans
from tidemark.plans import trust
from tidemark.plans.adapter import tables as register
from tidemark.plans.adapter import view
from tidemark.plans.registry import query
from tidemark.sources import store, tables
from tidemark.streaming import streams


def folder(s: SparkSession, name: str) -> str:
    """A new folder for written results: in the shared folder where one is set."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if s.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}/{name}"


def log(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vc").withColumn("ts", F.timestamp_micros("us"))


@query("a1", "SELECT revision_id FROM vc WHERE us >= 1704672000000000 AND us < 1705276800000000")
def a1(s: SparkSession, d: str) -> DataFrame:
    """A slice of the log written by month."""
    path = folder(s, "log")
    tables.write_log(log(s, d), path, "value_change", "ts")
    return tables.slice_scan(s.read.parquet(f"{path}/value_change"), "2024-01-08", "2024-01-15", "ts").select("revision_id")


query("a2", "SELECT revision_id, entity_id FROM vc WHERE CAST(entity_id AS STRING) LIKE '%0'")(lambda s, d: tables.entity_sample(view(s, d, "vc")).select("revision_id", "entity_id"))


@query("a4", "SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'click'")
def a4(s: SparkSession, d: str) -> DataFrame:
    register(s, d, "events")
    return tables.cell_query(s, "SELECT event_id FROM events WHERE user_id = ? AND event_type = ?", 7, "click")


def stored(s: SparkSession, d: str, run: int = 1, path: str | None = None) -> store.ResultStore:
    rows = series_plans.ser(s, d).withColumn("step_end", F.timestamp_seconds(F.lit(1704067200) + (F.col("step") + 1) * 259200))
    out = store.ResultStore(s, path or folder(s, "store"))
    out.write(store.series(rows, run, "created_per_property", ["property_id"]))
    return out


@query("a5", "SELECT count(*) AS n FROM vc")
def a5(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "log")
    tables.write_log(log(s, d), path, "value_change", "ts")
    return s.read.parquet(f"{path}/value_change").agg(F.count("*").alias("n"))


SER = "SELECT CAST(1704067200 + (step + 1) * 259200 AS BIGINT) AS end_s, CAST(property_id AS BIGINT) AS property_id, value FROM ser"


def back(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_timestamp("step_end").alias("end_s"), "property_id", "value")


query("a6", SER)(lambda s, d: back(stored(s, d).read()))


@query("a7", SER)
def a7(s: SparkSession, d: str) -> DataFrame:
    """Written twice: the second time replaces the first."""
    first = stored(s, d)
    return back(stored(s, d, path=first.path).read())


@query("a7_upsert", "SELECT step, property_id, CASE WHEN step >= 5 THEN -1.0 ELSE value END AS value FROM ser")
def a7_upsert(s: SparkSession, d: str) -> DataFrame:
    x = series_plans.ser(s, d)
    return tables.upsert(x, x.where("step >= 5").withColumn("value", F.lit(-1.0)), ["step", "property_id"])


query("a8", "SELECT step, count(*) AS n FROM ser GROUP BY step")(lambda s, d: series_plans.ser(s, d).groupBy("step").agg(F.count("*").alias("n")))
query("a9", "SELECT 'created_per_property' AS metric, 1 AS n")(lambda s, d: stored(s, d).catalogue().groupBy("metric").agg(F.countDistinct("metric_id").cast("int").alias("n")))


@query("a10", "SELECT entity_id, class_id FROM et")
def a10(s: SparkSession, d: str) -> DataFrame:
    st = store.ResultStore(s, folder(s, "store"))
    st.save_state("types", view(s, d, "et"), 3)
    return st.load_state("types", 3)


@query("a11", "SELECT max(step) AS step, 259200 AS length_seconds FROM ev")
def a11(s: SparkSession, d: str) -> DataFrame:
    """Where a run over the events stopped, saved and read back."""
    st = store.ResultStore(s, folder(s, "store"))
    st.save_position(view(s, d, "ev").agg(F.max("step")).first()[0], "2024-01-13", 259200)
    p = st.load_position()
    return s.createDataFrame([(p["step"], p["length_seconds"])], "step int, length_seconds int")


@query("a12", "SELECT 0 AS n")
def a12(s: SparkSession, d: str) -> DataFrame:
    st = store.ResultStore(s, folder(s, "store"))
    st.save_state("types", view(s, d, "et"), 3)
    st.wipe()
    return s.createDataFrame([(0 if st.load_state("types", 3) is None else 1,)], "n int")


@query("a14", "SELECT concat('Q', CAST(user_id AS STRING)) AS title, count(*) AS revisions, min(event_id) AS first, max(event_id) AS last FROM ev GROUP BY user_id")
def a14(s: SparkSession, d: str) -> DataFrame:
    """Entity pages of an XML dump made of the events, beside pages of other kinds."""
    ev, path = view(s, d, "ev"), folder(s, "dump")
    rev = F.concat(F.lit("<revision><id>"), F.col("event_id").cast("string"), F.lit("</id><timestamp>2013-01-01T00:00:00Z</timestamp><text>x</text></revision>"))
    both = ev.groupBy("user_id").agg(F.array_join(F.collect_list(rev), "").alias("r"))
    page = F.concat(F.lit("<page><title>"), F.col("kind"), F.col("user_id").cast("string"), F.lit("</title>"), F.col("r"), F.lit("</page>"))
    pages = both.select("user_id", "r", F.explode(F.array(F.lit("Q"), F.lit("P"))).alias("kind")).select((F.col("user_id") % 4).alias("part"), page.alias("page"))
    files = pages.groupBy("part").agg(F.concat(F.lit("<mediawiki>"), F.array_join(F.collect_list("page"), "\n"), F.lit("</mediawiki>")).alias("value"))  # a dump's files are documents
    files.write.partitionBy("part").text(path)
    ids = F.transform("revision", lambda r: r["id"])
    return tables.pages(s, path).select("title", F.size("revision").alias("revisions"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))


@query("a15", """SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN concat('{"a":"', event_type, '"}') WHEN 2 THEN concat('{"a":', CAST(event_id AS STRING), '}') END AS text FROM ev""")
def a15(s: SparkSession, d: str) -> DataFrame:
    """Texts with entities, broken ones, and ones with control characters."""
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("{&quot;a&quot;:&quot;"), "event_type", F.lit("&quot;}"))).when(kind == 1, F.lit("{broken")).otherwise(F.concat(F.lit('{"a":\x01'), F.col("event_id").cast("string"), F.lit("}")))
    return view(s, d, "ev").select(F.col("event_id").alias("n"), tables.clean_json(text).alias("text"))


@query("a16", "SELECT n_nationkey AS property_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('old ', n_name) END AS label FROM nation")
def a16(s: SparkSession, d: str) -> DataFrame:
    """A CSV file in which every second key comes again, with another label."""
    path, nation = folder(s, "labels"), s.read.parquet(f"{d}/nation.parquet").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))
    old = nation.select(F.lit(0).alias("o"), "n_nationkey", F.concat(F.lit("old "), "n_name").alias("label"))
    rows = old.unionByName(nation.where("n_nationkey % 2 = 0").select(F.lit(1).alias("o"), "n_nationkey", F.col("n_name").alias("label")))
    line = F.format_string("%d;%s", "n_nationkey", "label")
    rows.coalesce(1).sortWithinPartitions("o", "n_nationkey").select(line.alias("value")).write.text(path)
    return tables.read_dimension(s, path, "property_id int, label string", ["property_id"])


@query("a17", "SELECT DISTINCT user_id AS entity_id, user_id % 25 AS class_id, 'normal' AS rank FROM ev")
def a17(s: SparkSession, d: str) -> DataFrame:
    """Items of a dump, one per user."""
    item = '{"id":"Q%d","labels":{"en":{"value":"x"}},"aliases":{},"claims":{"P31":[{"rank":"normal","mainsnak":{"datavalue":{"value":{"id":"Q%d"}}}}]}}'
    users = view(s, d, "ev").select("user_id").distinct()
    return tables.dump_entities(users.select(F.format_string(item, "user_id", F.col("user_id") % 25).alias("json")))["entity_type"]


query("a18", "SELECT DISTINCT entity_id FROM ev WHERE step > 2 AND entity_id NOT IN (SELECT entity_id FROM ev WHERE step <= 2)")(
    lambda s, d: tables.insert_new(view(s, d, "ev").where("step <= 2"), view(s, d, "ev").where("step > 2"), ["entity_id"]).select("entity_id")
)


@query("a19", SER)
def a19(s: SparkSession, d: str) -> DataFrame:
    """A run exported, checked and imported elsewhere."""
    path, other = folder(s, "export"), store.ResultStore(s, folder(s, "store"))
    store.export_run(stored(s, d), 1, path)
    store.import_run(other, path)
    return back(other.read())


@query("a20", "SELECT src, dst, weight FROM edges")
def a20(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "graph")
    store.write_edges(trust.edges(s, d), path, 9)
    return s.read.option("header", "true").schema("src string, dst string, weight long").csv(f"{path}/step=9")


query("a24", "SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'even' ELSE concat('Q', CAST(entity_id AS STRING)) END AS label FROM et")(
    lambda s, d: tables.lookup_labels(view(s, d, "et").select("entity_id"), view(s, d, "et").where("entity_id % 2 = 0").select("entity_id", F.lit("even").alias("label")))
)


@query("a22", "SELECT step AS iteration, concat(event_type, '_count') AS metric, count(*) / 2.0e0 AS seconds FROM ev WHERE step < (SELECT max(step) FROM ev) GROUP BY step, event_type")
def a22(s: SparkSession, d: str) -> DataFrame:
    """A run's log made of the events; its last iteration has no closing line."""
    path, ev = folder(s, "runlog"), view(s, d, "ev")
    took = ev.groupBy("step", "event_type").count().select("step", F.lit(0).alias("o"), F.format_string("(Iteration %d) %s_count: took %.1f s", "step", "event_type", F.col("count") / 2).alias("value"))
    done = ev.groupBy().agg(F.max("step").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("step")).select("step", F.lit(1).alias("o"), F.format_string("Iteration %d done", "step").alias("value"))
    took.unionByName(done).coalesce(1).sortWithinPartitions("step", "o", "value").select("value").write.text(path)
    return tables.parse_log(s, path).select("iteration", "metric", "seconds")


@query("a26", "SELECT 'types' AS name, count(*) AS rows FROM et")
def a26(s: SparkSession, d: str) -> DataFrame:
    st = store.ResultStore(s, folder(s, "store"))
    st.save_state("types", view(s, d, "et"), 3)
    return st.state_sizes()


@query("j3", "SELECT event_type AS series, step AS day, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE event_type IN ('click', 'view') GROUP BY event_type, step")
def j3(s: SparkSession, d: str) -> DataFrame:
    """Series of a CSV file made of the events, a column per type."""
    path, ev = folder(s, "series"), view(s, d, "ev")
    wide = ev.groupBy("step").pivot("event_type", ["click", "view"]).count()
    wide.select(F.date_format(F.expr("date'2024-01-01' + make_interval(0, 0, 0, cast(step as int))"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "click", "view").write.option("header", "true").csv(path)
    day = F.date_diff(F.col("timestamp"), F.lit("2024-01-01")).cast("long")
    return tables.csv_series(s, path, ["click", "view"]).where("value is not null").select("series", day.alias("day"), "value")


@query("b20", "SELECT DISTINCT user_id AS entity_id, concat('label ', CAST(user_id % 10 AS STRING)) AS label FROM ev WHERE event_id % 5 = 0 AND user_id >= 10")
def b20(s: SparkSession, d: str) -> DataFrame:
    """Every fifth event redirects its user; users below 10 have labels of their own."""
    ev = view(s, d, "ev")
    comment = F.format_string("/* wbcreateredirect:0||Q%d|Q%d */", "user_id", F.col("user_id") % 10)
    revisions = ev.select(F.col("user_id").alias("entity_id"), (F.col("event_id") % 5 == 0).alias("redirect"), comment.alias("comment"))
    return tables.redirect_labels(revisions, s.range(10).select(F.col("id").alias("entity_id"), F.concat(F.lit("label "), F.col("id").cast("string")).alias("label")))


@query("b21", "SELECT entity_id, class_id, concat('class ', CAST(class_id AS STRING)) AS class_label FROM et")
def b21(s: SparkSession, d: str) -> DataFrame:
    et = view(s, d, "et")
    names = et.select(F.col("class_id").alias("entity_id"), F.lit("").alias("label"), F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("alias")).distinct()
    return tables.fill_class_labels(et.withColumn("class_label", F.lit(None).cast("string")), names).select("entity_id", "class_id", "class_label")


def edits(s: SparkSession, d: str, path: str) -> DataFrame:
    trust.refs(s, d).select("statement", "action", F.timestamp_micros("us").alias("ts")).repartition(2).write.parquet(path)
    return streams.read_stream(s, path, "statement string, action string, ts timestamp", 100)


def drained(s: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder(s, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


@query("k_steps", "SELECT step, count(*) FILTER (WHERE action = 'CREATE') AS created, count(*) FILTER (WHERE action = 'DELETE') AS deleted FROM rc GROUP BY step")
def k_steps(s: SparkSession, d: str) -> DataFrame:
    """Steps counted by a stream."""
    out = drained(s, streams.step_counts(edits(s, d, folder(s, "edits")), "3 days", "1 day"), "complete")
    return out.select(F.floor((F.unix_timestamp("start") - 1704067200) / 259200).cast("long").alias("step"), "created", "deleted")


@query("k_sessions", "SELECT statement, CAST(floor(us0 / 1000000) AS BIGINT) AS opened, edits FROM (SELECT statement, session, min(us) AS us0, count(*) AS edits FROM ses GROUP BY statement, session) x")
def k_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions found by a stream are those of the batch."""
    out = drained(s, streams.sessions(edits(s, d, folder(s, "edits"))), "complete")
    return out.select("statement", F.unix_timestamp("opened").alias("opened"), "edits")
