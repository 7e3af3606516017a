"""Session factory with the settings every tidemark plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with AQE; local unless a master is already configured."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    } | conf
    return builder.config(map=settings).getOrCreate()
