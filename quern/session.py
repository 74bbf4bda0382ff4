"""A session with what the library expects: UTC, adaptive plans, fair pools for the runner."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.scheduler.mode", "FAIR")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
