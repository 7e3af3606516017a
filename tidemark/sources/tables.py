"""Schemas, readers and writers of the change log and its dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHANGE = (
    "revision_id long, entity_id int, timestamp timestamp, property_id int, property_label string, value_id string, old_value string, new_value string, "
    "old_datatype string, new_datatype string, change_target string, action string, target string"
)
SCHEMAS: dict[str, str] = {
    "value_change": _CHANGE + ", old_hash string, new_hash string",
    "sitelink_change": _CHANGE + ", old_hash string, new_hash string",
    "rank_change": _CHANGE + ", old_hash string, new_hash string",
    "datatype_metadata_change": _CHANGE + ", old_hash string, new_hash string",
    "qualifier_change": _CHANGE + ", qual_property_id int, qual_property_id_label string, value_hash string",
    "reference_change": _CHANGE + ", ref_property_id int, ref_property_id_label string, ref_hash string, value_hash string",
    "revision": "prev_revision_id long, revision_id long, entity_id int, entity_label string, file_path string, timestamp timestamp, user_id string, username string, comment string, redirect boolean",
    "entity_type": "entity_id int, class_id int, rank string, class_label string",
    "subclass_of": "entity_id int, class_id int, rank string, class_label string",
    "entity_schemas": "entity_schema_id int, property_id int, min int, max int, value_constraint string",
    "schema_class_mapping": "class_id int, entity_schema_id int",
    "property_labels": "property_id int, label string",
    "property_constraints": "property_id string, constraint_type string, rank string, qualifier_id string, qualifier_value string",
}
#: Keys that make a change row unique.
KEYS = {
    "value_change": ["revision_id", "property_id", "value_id", "change_target"],
    "qualifier_change": ["revision_id", "property_id", "value_id", "qual_property_id", "value_hash", "change_target"],
    "reference_change": ["revision_id", "property_id", "value_id", "ref_hash", "ref_property_id", "value_hash", "change_target"],
    "revision": ["revision_id"],
}


def read_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def write_log(rows: DataFrame, path: str, name: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Appends rows to the log, a folder per month so that a time slice reads its months only."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).repartition("month").sortWithinPartitions(ts).write.mode(mode).partitionBy("month").parquet(f"{path}/{name}")


def slice_scan(log: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """Rows of [start, end); the months of the folder layout are pruned where the table has them."""
    out = log.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    if "month" in log.columns:
        first, last = F.date_format(F.lit(start).cast("timestamp"), "yyyy-MM"), F.date_format(F.lit(end).cast("timestamp"), "yyyy-MM")
        out = out.where((F.col("month") >= first) & (F.col("month") <= last))
    return out


def entity_sample(log: DataFrame, digit: str = "0") -> DataFrame:
    """The tenth of entities whose id ends in digit."""
    return log.where(F.col("entity_id").cast("string").endswith(digit))


def attach_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: Sequence[int], **options: str) -> DataFrame:
    """A table of an external database, read in ranges of key."""
    predicates = [f"{key} >= {a} and {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def cell_query(spark: SparkSession, sql: str, *args, **views: DataFrame) -> DataFrame:
    """SQL with positional parameters. Errors are raised, never an empty result."""
    return spark.sql(sql, args=list(args) or None, **views)


def insert_new(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to append: one of each key that isn't there yet."""
    fresh = rows.dropDuplicates(list(keys))
    return fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with rows in place of those of the same key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_rank", last).where("_rank = 1").drop("_rank", "_new")


def read_dimension(spark: SparkSession, path: str, schema: str, keys: Sequence[str], sep: str = ";") -> DataFrame:
    """A dimension from CSV: distinct rows, of each key the last in the file."""
    rows = spark.read.option("sep", sep).schema(schema).csv(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    columns = [c for c in rows.columns if c != "_at"]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "_at").alias(c) for c in columns if c not in keys)).select(*columns)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, revisions) of the entity pages of XML dumps, compressed or not."""
    revision = "struct<id:bigint,parentid:bigint,timestamp:string,comment:string,contributor:struct<id:string,username:string>,text:struct<_VALUE:string,_deleted:string>>"
    schema = f"title string, redirect struct<_title:string>, revision array<{revision}>"
    return spark.read.format("xml").option("rowTag", "page").option("attributePrefix", "_").schema(schema).load(path).where(F.col("title").startswith("Q"))


def clean_json(text):
    """Revision text as JSON: entities unescaped, curly quotes straightened, control characters dropped; the raw text where only that
    can be read, null where neither can."""
    out = text
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.translate(out, "“”‘’", "\"\"''")
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    valid = F.try_parse_json(out).isNotNull()
    return F.when(valid, out).when(F.try_parse_json(text).isNotNull(), text)


def dump_entities(items: DataFrame) -> dict[str, DataFrame]:
    """Labels with first alias, P31, P279 (with rank) of items (entity JSON in column json)."""
    claim = "array<struct<rank:string,mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>"
    schema = f"id string, labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, claims struct<P31:{claim},P279:{claim}>"
    e = items.select(F.from_json("json", schema).alias("e")).select("e.*").withColumn("entity_id", F.substring("id", 2, 12).try_cast("int"))
    labels = e.select("entity_id", F.try_element_at("labels", F.lit("en"))["value"].alias("label"), F.get(F.try_element_at("aliases", F.lit("en")), F.lit(0))["value"].alias("alias"))

    def of(p: str) -> DataFrame:
        c = e.select("entity_id", F.explode(f"claims.{p}").alias("c"))
        return c.select("entity_id", F.substring(F.col("c.mainsnak.datavalue.value.id"), 2, 12).try_cast("int").alias("class_id"), F.col("c.rank").alias("rank")).where("class_id is not null")

    return {"entity_labels": labels, "entity_type": of("P31"), "subclass_of": of("P279")}


def redirect_labels(revisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of redirected entities that have none: that of the entity in the comment's fourth part."""
    to = F.regexp_replace(F.split_part("comment", F.lit("|"), F.lit(4)), "[^Q0-9]", "")
    moved = revisions.where("redirect").select("entity_id", F.regexp_replace(to, "Q", "").try_cast("int").alias("_to")).distinct()
    named = moved.join(labels.select(F.col("entity_id").alias("_to"), "label"), "_to").select("entity_id", "label")
    return named.join(labels.select("entity_id").distinct(), "entity_id", "left_anti")


def fill_class_labels(types: DataFrame, labels: DataFrame) -> DataFrame:
    """Class labels of entity_type or subclass_of: the label, else the first alias."""
    names = labels.select(F.col("entity_id").alias("class_id"), F.coalesce(F.nullif("label", F.lit("")), "alias").alias("class_label"))
    return types.drop("class_label").join(names, "class_id", "left")


def lookup_labels(ids: DataFrame, labels: DataFrame, key: str = "entity_id", prefix: str = "Q") -> DataFrame:
    """Labels of ids from a local table; the bare id where there is none."""
    return ids.join(labels.select(key, "label"), key, "left").withColumn("label", F.coalesce("label", F.concat(F.lit(prefix), F.col(key).cast("string"))))


def csv_series(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(series, timestamp, value) of columns of a CSV file with a timestamp column; times without a zone are UTC. Missing values stay, as gaps.

    A column that is absent, or has no value at all, is an error.
    """
    rows = spark.read.option("header", "true").csv(path)
    absent = [c for c in ["timestamp", *columns] if c not in rows.columns]
    if absent:
        raise ValueError(f"{path} lacks {absent}")
    number = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double") for c in columns}
    seen = rows.agg(*(F.count(F.nullif(v, F.lit(float("nan")))).alias(c) for c, v in number.items())).first()
    empty = [c for c in columns if not seen[c]]
    if empty:
        raise ValueError(f"{path} has no data in {empty}")
    zoned = F.when(F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("timestamp")).otherwise(F.concat("timestamp", F.lit("Z"))).cast("timestamp")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), v.alias("value")) for c, v in number.items())))
    return rows.select(zoned.alias("timestamp"), each.alias("s")).select("s.series", "timestamp", "s.value")


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, metric, seconds) from run logs: the iteration named last above a timing line holds for it.

    An iteration without a closing line is left out. Line order matters, so lines are numbered within their file.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    step = F.nullif(F.regexp_extract("value", r"\(Iteration (\d+)\)", 1), F.lit("")).cast("int")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("iteration", F.last(step, ignorenulls=True).over(w)).withColumns(
        {"metric": F.regexp_extract("value", r"^\s*(?:\(Iteration \d+\)\s*)?(\w+):? .*?([0-9.]+) ?s", 1), "seconds": F.regexp_extract("value", r"^\s*(?:\(Iteration \d+\)\s*)?(\w+):? .*?([0-9.]+) ?s", 2).try_cast("double")}
    )
    done = rows.where(F.col("value").rlike("(?i)iteration.*(done|finished)|step finished")).select("file", "iteration").distinct()
    return rows.where("seconds is not null and metric <> ''").join(done, ["file", "iteration"], "left_semi").select("file", "iteration", "metric", "seconds")
