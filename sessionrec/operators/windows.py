"""Ranks, recent events and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.functions.weights import event_weight, target_value



def newest_first() -> list[Column]:
    return [F.desc(c) for c in ("ts", "aid", "type")]


def prune_topk(df: DataFrame, group: list[str], score: str, k: int, tie: list[str], rank: str = "rank") -> DataFrame:
    """The k rows of each group with the greatest scores (9 decimals count, then the tie columns)."""
    order = Window.partitionBy(*group).orderBy(F.round(score, 9).desc(), *tie)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def recent_session_events(events: DataFrame, n: int) -> DataFrame:
    """The newest n events of each session."""
    return recent_seeds(events, n).drop("seed_rank")


def recent_seeds(events: DataFrame, n: int = 20) -> DataFrame:
    """The newest n events of each session with seed_rank 1, 2, ...; items may repeat."""
    order = Window.partitionBy("session").orderBy(*newest_first())
    return events.withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= n)


def recent_seed_items(events: DataFrame, n: int = 20) -> DataFrame:
    """Distinct items of the newest n events of each session."""
    return recent_seeds(events, n).select("session", "aid").distinct()


def recent_unique_items(events: DataFrame, k: int) -> DataFrame:
    """session, aid, pos: the newest k distinct items of each session, newest first."""
    last = events.groupBy("session", "aid").agg(F.max("ts").alias("last"))
    order = Window.partitionBy("session").orderBy(F.desc("last"), F.desc("aid"))
    return last.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("session", "aid", "pos")


def _popular(events: DataFrame, weight: Column, k: int) -> DataFrame:
    best = events.groupBy("aid").agg(F.sum(weight).alias("score")).orderBy(F.desc("score"), "aid").limit(k)
    # k rows at most are ranked in one task.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "aid")))


def popular_items(events: DataFrame, k: int = 20) -> DataFrame:
    """The k items of the greatest summed popularity weight."""
    return _popular(events, event_weight(F.col("type")), k)


def popular_fallback_items(events: DataFrame, k: int = 20) -> DataFrame:
    """The k items of the greatest summed target weight."""
    return _popular(events, target_value(F.col("type")), k)
