"""Sessions with the settings that the library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def utc(spark: SparkSession) -> SparkSession:
    """Days and minutes are UTC ones: sets the session's time zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for development and tests."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("candlewick").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return utc(b.getOrCreate())
