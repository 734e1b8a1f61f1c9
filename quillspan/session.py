"""The session, with only the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; partitions and memory are the cluster's affair."""
    builder = SparkSession.builder.appName("quillspan")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
