"""A session with settings that suit the plans here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "weftgraph", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution with skew handling; what a cluster sets itself (master, memory, partitions) is left to it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (own | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
