"""Splits of events into features and labels, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.operators.windows import newest_first
from sessionrec.schema import CART, CLICK, DAY_MS, ORDER


def grouped_labels(events: DataFrame) -> DataFrame:
    """session, type, ground_truth: distinct items in time order."""
    timed = F.array_sort(F.collect_list(F.struct("ts", "aid")))
    items = F.array_distinct(F.transform(timed, lambda e: e["aid"]))
    return events.groupBy("session", "type").agg(items.alias("ground_truth"))


def split_tail(events: DataFrame, held: int = 1, min_length: int = 2, whole_times: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train events, labels): the last `held` events of sessions with min_length events or more are labels.

    whole_times: events of the same time as the first held one are held too, so that no label's
    time is among its features.
    """
    by_session = Window.partitionBy("session")
    rows = events.withColumn("_pos", F.row_number().over(by_session.orderBy(*newest_first()))).withColumn("_len", F.count(F.lit(1)).over(by_session))
    long_enough = F.col("_len") >= min_length
    if whole_times:
        from_ts = F.min(F.when(F.col("_pos") <= held, F.col("ts"))).over(by_session)
        rows = rows.withColumn("_label", long_enough & (F.col("ts") >= from_ts))
    else:
        rows = rows.withColumn("_label", long_enough & (F.col("_pos") <= held))
    return rows.where(~F.col("_label")).select(*events.columns), grouped_labels(rows.where("_label"))


def with_cutoff(events: DataFrame, days: float = 1.0, cutoff: int | None = None) -> DataFrame:
    if cutoff is not None:
        return events.withColumn("cutoff", F.lit(cutoff).cast("long"))
    last = events.agg((F.max("ts") - F.lit(int(days * DAY_MS))).cast("long").alias("cutoff"))
    return events.crossJoin(F.broadcast(last))  # one row


def split_time(events: DataFrame, days: float = 1.0, cutoff: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature events before the cutoff, label events from it on); the cutoff is `days` before the last event."""
    rows = with_cutoff(events, days, cutoff)
    return rows.where("ts < cutoff").drop("cutoff"), rows.where("ts >= cutoff").drop("cutoff")


#: Sides of a time split.
TRAIN, LABEL = 0, 1


def with_side(events: DataFrame, days: float = 1.0, cutoff: int | None = None) -> DataFrame:
    """Events with their side of the time split, for both sides to be written as one table."""
    rows = with_cutoff(events, days, cutoff)
    return rows.withColumn("side", F.when(F.col("ts") < F.col("cutoff"), TRAIN).otherwise(LABEL)).drop("cutoff")


def label_targets(label_events: DataFrame) -> DataFrame:
    """session, aid, target_click, target_cart, target_order (0 or 1)."""
    flag = lambda code, name: F.max(F.when(F.col("type") == code, 1).otherwise(0)).cast("tinyint").alias(name)
    return label_events.groupBy("session", "aid").agg(flag(CLICK, "target_click"), flag(CART, "target_cart"), flag(ORDER, "target_order"))


def split_audit(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sizes and times of both sides, targets, and sessions on both sides whose features all come before their labels, or not."""
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"{name}_events"), F.count_distinct("session").alias(f"{name}_sessions"), F.min("ts").alias(f"{name}_min_ts"), F.max("ts").alias(f"{name}_max_ts"))
    targets = label_targets(labels).agg(F.count(F.lit(1)).alias("targets"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("target_click", "target_cart", "target_order")])
    last = features.groupBy("session").agg(F.max("ts").alias("last"))
    first = labels.groupBy("session").agg(F.min("ts").alias("first"))
    both = last.join(first, "session").agg(F.count(F.lit(1)).alias("both_sides"), F.count_if(F.col("last") < F.col("first")).alias("strict_ok"), F.count_if(F.col("last") >= F.col("first")).alias("violations"))
    out = side(features, "feature")
    for one_row in (side(labels, "label"), targets, both):
        out = out.crossJoin(F.broadcast(one_row))
    return out
