"""Session factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bytes of a batch that a Python worker holds; a task may have several workers, and each
# keeps a few copies of its batch.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")

# Everything here is a setting, not a requirement: on a cluster the submit-time
# configuration wins, because getOrCreate() returns the running session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    ARROW_BATCH[0]: ARROW_BATCH[1],
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app_name: str = "seekspark",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
