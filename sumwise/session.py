"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own.

    Plans that store results need `spark.checkpoint.dir`, here too: name it in `extra`.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sumwise")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
