"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "marketlens", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on and a UTC clock.

    ``master`` stays unset on a cluster (spark-submit names it). Shuffle partitions are
    left to the cluster's setting; adaptive execution coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
