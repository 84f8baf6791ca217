"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; ``master`` only where no cluster manager sets it."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
