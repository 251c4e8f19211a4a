"""The Spark settings this library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps in the raw tables carry no zone; UTC keeps zoned ones on the same clock.
    "spark.sql.session.timeZone": "UTC",
    # Overflow and bad casts are errors, never silent NULLs.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An aggregate right above a join reuses the join's partitioning, which would stop AQE from
    # splitting a hot order; this lets it split and pay one more shuffle in that case only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python call site of every column costs several JVM round trips each; a model
    # has hundreds of columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "shopmeld", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` keys use '__' for '.', e.g. spark__sql__shuffle__partitions."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
