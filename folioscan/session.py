"""The session that tests, benchmarks and scripts share."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, name: str = "folioscan") -> SparkSession:
    """A local session with the settings that results depend on: UTC, AQE, Arrow."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that carry whole texts to Python, by rows and bytes; the session keeps these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
