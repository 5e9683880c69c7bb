"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "termdrift", **settings: str) -> SparkSession:
    """settings: more Spark settings, with dots written as two underscores."""
    more = {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **more}).getOrCreate()
