"""Session defaults; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the library's results or plans rely on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` adds settings (dots written as two underscores)."""
    builder = SparkSession.builder.appName("lakewright")
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
