"""One place that builds a session with the settings every plan here expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; `conf` overrides with dots written as underscores-free keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
