"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "lexspark", master: str = "local[*]", **settings: str) -> SparkSession:
    """A session for tests and the command line; on a cluster, use the one it gives."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
