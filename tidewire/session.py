"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skewed joins split; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()
