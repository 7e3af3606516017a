"""Results that are read several times, settled once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and read from the shared checkpoint folder from then on: later plans don't repeat it, and
    lost executors don't either. A folder of our own is set only where none is and all is one process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
