"""One place for session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What every job here relies on: UTC, ANSI, adaptive plans, and partition-wise overwrite.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.files.ignoreMissingFiles": "true",
}


def build(name: str = "pulsegrid", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and `more` (underscores stand for dots)."""
    b = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()
