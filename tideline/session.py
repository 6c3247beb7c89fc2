"""A Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above 8000 bytes; larger generated ones would be interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """Build or get a session. On a cluster leave ``master`` and ``shuffle_partitions`` to the submit settings."""
    builder = SparkSession.builder.appName("tideline")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
