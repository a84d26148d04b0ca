"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def create(app: str = "shelfspark", **settings: str) -> SparkSession:
    """A session with times in UTC (weeks are cut at UTC midnight) and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
