"""Agent event streams: incremental tool counts. Time windows are an extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.scale import checkpoint_dir


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream the event table; its schema comes from the stored files."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events and value per type and window; state is dropped once the watermark passed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def run_to_memory(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Drain the available input into a memory table; for tests and small results.

    The state lies in the shared checkpoint folder; the memory table holds the result on
    the driver, so a large result belongs in a file sink.
    """
    state = f"{checkpoint_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)
