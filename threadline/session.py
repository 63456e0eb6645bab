"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "threadline", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | settings
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
