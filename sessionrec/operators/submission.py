"""Predictions in the forms of a submission and of the metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.schema import TYPE_CODES


def ordered_lists(candidates: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", "aid")))
    return candidates.groupBy("session").agg(F.transform(ranked, lambda x: x["aid"]).alias("labels"))


def predictions_for_metric(candidates: DataFrame, types: tuple[str, ...] = tuple(TYPE_CODES)) -> DataFrame:
    """session, type, labels: a row for each session and type."""
    return ordered_lists(candidates).select("session", F.explode(F.array(*map(F.lit, types))).alias("type"), "labels")


def format_submission(candidates: DataFrame, types: tuple[str, ...] = tuple(TYPE_CODES)) -> DataFrame:
    """session_type, labels: items in the order of their rank, parted by blanks."""
    rows = predictions_for_metric(candidates, types)
    return rows.select(F.concat_ws("_", F.col("session").cast("string"), "type").alias("session_type"), F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))
