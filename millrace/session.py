"""A session with the settings that the operators expect; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "millrace", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
