"""Features of visits: stretches of a session without a long pause, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.operators.features import BROWSING_LENGTH
from sessionrec.schema import CART, EVENTS, ORDER


def visit_features(events: DataFrame, gap: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """A row for each visit, with the features of session_features(): a visit ends where the next event is more than `gap` later.

    The same plan serves tables and streams. On a stream, state holds the open visits of each session, out-of-order
    events open, lengthen and join them, and a visit is given once, when the watermark (the greatest time so far less `delay`) is
    past its end and its state goes. Events later than that are dropped; on a table nothing is late.
    """
    rows = events.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", delay)
    count = lambda code: F.count_if(F.col("type") == code)
    out = rows.groupBy("session", F.session_window("time", gap).alias("visit")).agg(
        F.count(F.lit(1)).alias("visit_length"), F.size(F.collect_set("aid")).cast("long").alias("unique_items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), count(CART).alias("cart_count"), count(ORDER).alias("order_count"),
    )
    browsing = (F.col("visit_length") >= BROWSING_LENGTH) & (F.col("cart_count") == 0) & (F.col("order_count") == 0)
    return out.drop("visit").withColumn("duration", F.col("last_ts") - F.col("first_ts")).withColumn("is_window_shopping", browsing.cast("tinyint"))


def write_visits(spark: SparkSession, source: str, target: str, checkpoint: str, gap: str = "1 day", delay: str = "1 hour", files: int | None = None) -> None:
    """Takes in the event files of a folder that are new since the last call, and appends the visits that have ended to a parquet table.

    files: how many go to one batch. State and progress are in the checkpoint folder, so a run that fails goes on where it was.
    """
    reader = spark.readStream.schema(EVENTS)
    events = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    query = visit_features(events, gap, delay).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
