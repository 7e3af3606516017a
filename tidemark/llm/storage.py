"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A folder of our own only where none is set and driver and executors are one process."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(SETTING, base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class Tables:
    """The working tables that operators write within it (``with tables: ...``). Nobody else's are touched by release."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._tokens: list = []

    def __enter__(self) -> Tables:
        self._tokens.append(_current.set(self))
        return self

    def __exit__(self, *error: object) -> None:
        _current.reset(self._tokens.pop())

    def release(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Deletes them, but for those that keep reads. For callers that have written the results which came from them."""
        read = roots(keep) if keep is not None else []
        for path in list(self.paths):
            if not any(path.rsplit("/", 1)[-1] in r for r in read):
                fs, target = _file_system(spark, path)
                fs.delete(target, True)
                self.paths.remove(path)


_current: ContextVar[Tables | None] = ContextVar("tidemark_tables", default=None)


def roots(df: DataFrame) -> list[str]:
    """The paths that df's file scans were given, from its plan: no file is listed."""
    out, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(i).toString() for i in range(paths.size())]
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; it goes with its ``Tables``, or else when the application ends."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    owner = _current.get()
    if owner is not None:
        owner.paths.append(path)
    return f"{path}/{name}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def saved(df: DataFrame, name: str, codec: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The query's shuffle files go as soon as it is done, where Spark offers that. batch: how many rows go to Python at once.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    with ExitStack() as settings:
        settings.enter_context(setting(spark, CLEANUP, "true"))
        if batch is not None:
            settings.enter_context(setting(spark, BATCH, str(batch)))
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def packed(docs: DataFrame, *without: str, name: str = "doc"):
    """A struct of docs' columns (but for some), so that an operator's own names can't clash with any of them."""
    from pyspark.sql import functions as F

    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without)).alias(name)


def tasks_for(df: DataFrame, size: int, text: str = "text") -> int:
    """How many tasks deal df out at about ``size`` bytes of text each: from what Spark knows of its files, where it does.

    Files hold text in about a third of its size. At least spark.sql.shuffle.partitions.
    """
    from pyspark.sql import functions as F

    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n_bytes = 3 * known if known < 1 << 55 else df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // size))
