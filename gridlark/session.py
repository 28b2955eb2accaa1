"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridlark", **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; cluster settings such as the master stay with the caller."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
