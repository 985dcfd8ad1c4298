"""A Spark session with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app_name: str = "stepwell", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session: UTC clock, adaptive execution on, no web page.

    ``master`` stays unset on a cluster, where spark-submit names it. ``conf`` keys use
    ``__`` for ``.``, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
