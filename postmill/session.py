"""Session settings the jobs rely on. A cluster's own values win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Work on pages is heavy per byte, so scans are cut finer than by default, at any size of the input.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages differ widely in size: bound Arrow batches by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build(app: str = "postmill", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
