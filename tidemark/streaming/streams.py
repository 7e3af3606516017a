"""Streams over the change log: windows of a step, sessions that close with the watermark, expiry.

Events that come later than the watermark allows are dropped; the batch operators see complete history instead. Checkpoints make
every stream resumable.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "statement string, edits long, last timestamp, opened timestamp"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def step_counts(stream: DataFrame, step: str = "30 days", origin: str = "12 days", late: str = "2 days") -> DataFrame:
    """Creations and deletions per tumbling step. origin counts from 1970: steps of 30 days from 2012-10-29 have 12 days."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", step, startTime=origin).alias("w"))
        .agg(F.count_if(F.col("action") == "CREATE").alias("created"), F.count_if(F.col("action") == "DELETE").alias("deleted"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "created", "deleted")
    )


def sessions(stream: DataFrame, gap: str = "2 days", late: str = "2 days") -> DataFrame:
    """Sessions of edits per statement; a pause of exactly the gap continues one."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("statement", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("edits"), F.max("ts").alias("last"))
        .select("statement", F.col("w.start").alias("opened"), "last", "edits")
    )


def stateful_sessions(stream: DataFrame, gap_seconds: int = 2 * 86400, late: str = "2 days") -> DataFrame:
    """The same by a state of its own per statement: (first, last, edits) of the open session, closed by the watermark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, last, first)], columns=["statement", "edits", "last", "opened"])
            return
        gap = pd.Timedelta(seconds=gap_seconds)
        done = []
        first, last, n = state.get if state.exists else (None, None, 0)
        for ts in sorted(t for pdf in batches for t in pdf["ts"]):
            if last is not None and ts - last > gap:
                done.append((key[0], n, last, first))
                first, n = None, 0
            first, last, n = first or ts, ts, n + 1
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["statement", "edits", "last", "opened"])

    return stream.withWatermark("ts", late).groupBy("statement").applyInPandasWithState(run, SESSION, "first timestamp, last timestamp, n long", "append", GroupStateTimeout.EventTimeTimeout)


def write_steps(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's rows in place of those of the same steps, so that a batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
