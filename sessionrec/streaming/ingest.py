"""Session documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.schema import SESSION_JSON
from sessionrec.sources.events import flatten_sessions


def stream_session_json(spark: SparkSession, path: str) -> DataFrame:
    """Events of the session files that arrive in a folder, as they arrive."""
    return flatten_sessions(spark.readStream.schema(SESSION_JSON).json(path).where("session is not null"))


def recent_popularity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each item in each span of event time; spans close when the watermark has passed them."""
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("span"), "aid").agg(F.count(F.lit(1)).alias("events")).select(F.col("span.start").alias("start"), "aid", "events")
