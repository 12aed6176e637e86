"""Session construction for tests, benches and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "strandline", cores: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session with the settings the engine assumes anywhere: UTC, AQE and Arrow."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
