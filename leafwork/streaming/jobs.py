"""Streams of progress events: reading, sessions and windows.  Job states and the register
are in job_states.py and register_stream.py, messages in sources/progress_source.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files; their times become timestamps, which watermarks need."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def parse_events(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON messages as rows; malformed ones are dropped."""
    return raw.select(F.from_json(F.col(column).cast("string"), schema).alias("e")).where("e is not null").select("e.*")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Runs of events with no pause of ``gap``: batch or stream."""
    rows = events.withWatermark("ts", delay) if delay else events
    s = F.session_window("ts", gap)
    return rows.groupBy(key, s).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windows(events: DataFrame, size: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """Counts by tumbling window and type."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into an in-memory table and returns it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)
