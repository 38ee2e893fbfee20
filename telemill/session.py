"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """A UTC session with adaptive execution; settings of a running cluster session win where it exists."""
    b = SparkSession.builder.master(master).appName("telemill")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **more,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
