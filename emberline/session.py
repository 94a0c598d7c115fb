"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "emberline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew handling and dynamic partition overwrite."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
