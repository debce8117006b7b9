"""A session with the settings the operators are tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sluice", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting, Arrow for Python stages; ``conf`` overrides."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
