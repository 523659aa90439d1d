"""A Spark session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "strophe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew-join and coalescing, Arrow; further settings by keyword with '__' for '.'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
