"""A session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf) -> SparkSession:
    """Adaptive plans, skew joins split, UTC times; on a cluster leave master unset and size shuffles there."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
