"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """ANSI on (casts and overflows are errors, never nulls), adaptive execution with skew joins, Arrow, one BLAS thread a task."""
    b = SparkSession.builder.appName("fitloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.executorEnv.OMP_NUM_THREADS": "1", "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=settings | conf).getOrCreate()


def worker_count(spark: SparkSession, tasks: int, wanted: int | None = None) -> int:
    """How many tasks run side by side: as wanted, else the cores that there are; never more than there is work, and at least one."""
    if wanted is not None and wanted < 1:
        raise ValueError("workers must be positive")
    return max(1, min(tasks, wanted or spark.sparkContext.defaultParallelism))
