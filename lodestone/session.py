"""Session settings that the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``more`` adds settings, with
    dots written as double underscores."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
