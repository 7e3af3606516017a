"""The result store: keyed time series, their catalogue, state tables, and transfer of runs.

A series row is (run_id, metric, step_end, entity_id, class_id, property_id, entity_schema_id, value_id, key_string, value). Rows lie in folders by
run and metric; writing a metric's step again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DIMENSIONS = ["entity_id", "class_id", "property_id", "entity_schema_id", "value_id", "key_string"]
TYPES = dict.fromkeys(DIMENSIONS[:4], "long") | dict.fromkeys(DIMENSIONS[4:], "string")


def series(rows: DataFrame, run_id: int, metric: str, dims: Sequence[str] = ()) -> DataFrame:
    """rows (step_end, dims..., value) as store rows. A value that isn't a double, or an unknown dimension, is an error."""
    if dict(rows.dtypes)["value"] != "double":
        raise TypeError(f"{metric}: values must be doubles")
    if unknown := set(dims) - set(DIMENSIONS):
        raise ValueError(f"{metric}: no such dimension {sorted(unknown)}")
    columns = [F.col(c).cast(TYPES[c]).alias(c) if c in dims else F.lit(None).cast(TYPES[c]).alias(c) for c in DIMENSIONS]
    return rows.select(F.lit(run_id).cast("long").alias("run_id"), F.lit(metric).alias("metric"), F.col("step_end"), *columns, "value")


class ResultStore:
    """Series, catalogue and state below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame) -> None:
        """Replaces the (run, metric, step_end) folders that rows have, keeps the others."""
        out = rows.withColumn("step", F.date_format("step_end", "yyyyMMdd'T'HHmmss"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "metric", "step").parquet(f"{self.path}/series")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/series").drop("step")

    def catalogue(self) -> DataFrame:
        """(metric, metric_id): ids by name, the same in every store."""
        return self.read().select("metric").distinct().withColumn("metric_id", F.abs(F.xxhash64("metric") % (2**31)))

    def save_state(self, name: str, state: DataFrame, step: int) -> None:
        """All rows of a metric's state after a step."""
        state.write.mode("overwrite").parquet(f"{self.path}/state/{name}/step={step}")

    def load_state(self, name: str, step: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/state/{name}/step={step}")
        except AnalysisException:
            return None

    def save_position(self, step: int, end: str, length_seconds: int) -> None:
        self.spark.createDataFrame([(step, end, length_seconds)], "step int, step_end string, length_seconds long").coalesce(1).write.mode("overwrite").json(f"{self.path}/position")

    def load_position(self) -> dict | None:
        try:
            row = self.spark.read.json(f"{self.path}/position").first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def wipe(self) -> None:
        """Removes everything below the path."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def state_sizes(self) -> DataFrame:
        """(name, rows) of the state tables."""
        files = self.spark.read.option("recursiveFileLookup", "true").format("parquet").load(f"{self.path}/state").select(F.input_file_name().alias("f"))
        return files.groupBy(F.regexp_extract("f", r"/state/([^/]+)/", 1).alias("name")).agg(F.count("*").alias("rows"))


def digest(rows: DataFrame) -> DataFrame:
    """(metric, rows, checksum) of store rows; the checksum doesn't depend on their order."""
    h = F.sha2(F.to_json(F.struct("metric", "step_end", *DIMENSIONS, "value")), 256)
    return rows.groupBy("metric").agg(F.count("*").alias("rows"), F.hex(F.bit_xor(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))).alias("checksum"))


def export_run(store: ResultStore, run_id: int, path: str) -> None:
    """Writes one run and its manifest to path."""
    rows = store.read().where(F.col("run_id") == run_id)
    rows.write.mode("overwrite").parquet(f"{path}/series")
    digest(rows).withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_run(store: ResultStore, path: str, replace: bool = False, dry_run: bool = False) -> str:
    """'imported', 'skipped' where the run is there already, or 'checked'. Rows that differ from the manifest are an error."""
    spark = store.spark
    rows, manifest = spark.read.parquet(f"{path}/series"), spark.read.json(f"{path}/manifest")
    have, want = digest(rows).select("metric", "rows", "checksum"), manifest.select("metric", "rows", "checksum")
    if have.exceptAll(want).take(1) or want.exceptAll(have).take(1):
        raise ValueError(f"{path}: rows differ from the manifest")
    run_id = manifest.first()["run_id"]
    try:
        present = bool(store.read().where(F.col("run_id") == run_id).take(1))
    except AnalysisException:
        present = False
    if present and not replace:
        return "skipped"
    if dry_run:
        return "checked"
    store.write(rows)
    return "imported"


def write_edges(edges: DataFrame, path: str, step: int) -> None:
    """A snapshot of a graph: compressed CSV in a folder of its step, visible once whole."""
    edges.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(f"{path}/step={step}")


