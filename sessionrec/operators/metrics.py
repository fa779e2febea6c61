"""Recall and candidate pool figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.weights import by_type
from sessionrec.schema import METRIC_WEIGHTS, TYPE_CODES


def explode_labels(labels: DataFrame) -> DataFrame:
    return labels.select("session", "type", F.explode("ground_truth").alias("aid"))


def parse_labels(value: Column) -> Column:
    """Items of a list that is parted by white space; a blank one is empty."""
    inner = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, " ").cast("array<int>"))


def metric_weight(type_: Column) -> Column:
    return by_type(METRIC_WEIGHTS, type_, 0.0)


def _as_array(df: DataFrame, name: str) -> Column:
    return F.col(name) if df.schema[name].dataType.typeName() == "array" else parse_labels(F.col(name))


def recall_at_k_capped(labels: DataFrame, predictions: DataFrame, k: int = 20) -> DataFrame:
    """One row, weighted_recall: per type name, hits among the first k predictions over labels counted up to k each; weighted over types with labels."""
    for df, needed in ((labels, ("session", "type", "ground_truth")), (predictions, ("session", "type", "labels"))):
        missing = sorted(set(needed) - set(df.columns))
        if missing:
            raise ValueError(f"columns are missing: {missing}")
    truth = labels.select("session", "type", F.array_distinct(_as_array(labels, "ground_truth")).alias("truth")).where(F.size("truth") > 0)
    found = predictions.select("session", "type", F.slice(_as_array(predictions, "labels"), 1, k).alias("found"))
    rows = truth.join(found, ["session", "type"], "left")
    rows = rows.groupBy("type").agg(F.sum(F.coalesce(F.size(F.array_intersect("truth", "found")), F.lit(0))).alias("hits"), F.sum(F.least(F.size("truth"), F.lit(k))).alias("total"))
    weight = F.lit(0.0)
    for name, code in TYPE_CODES.items():
        weight = F.when(F.col("type") == name, METRIC_WEIGHTS[code]).otherwise(weight)
    return rows.agg(F.coalesce(F.try_divide(F.sum(weight * F.col("hits") / F.col("total")), F.sum(weight)), F.lit(0.0)).alias("weighted_recall"))


def recall_at_k(labels: DataFrame, recommendations: DataFrame, k: int = 20) -> DataFrame:
    """type, total, hits, recall, metric_weight, weighted_recall: all labels count, whatever k."""
    wanted = explode_labels(labels)
    best = recommendations.where(F.col("rank") <= k).select("session", "aid").distinct().withColumn("hit", F.lit(1))
    rows = wanted.join(best, ["session", "aid"], "left").groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits"))
    rows = rows.withColumn("recall", F.col("hits") / F.col("total")).withColumn("metric_weight", metric_weight(F.col("type")))
    overall = rows.agg(F.try_divide(F.sum(F.col("recall") * F.col("metric_weight")), F.sum("metric_weight")).alias("weighted_recall"))
    return rows.crossJoin(F.broadcast(overall))  # one row


def candidate_pool_summary(candidates: DataFrame, least: int = 50, full: int = 100) -> DataFrame:
    counts = candidates.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("sessions"), F.min("n").alias("min_candidates"), F.avg("n").alias("mean_candidates"), F.median("n").alias("median_candidates"), F.max("n").alias("max_candidates"),
        F.count_if(F.col("n") >= least).alias("sessions_ge_min"), F.count_if(F.col("n") == full).alias("sessions_full"),
    )


def candidate_coverage(labelled: DataFrame, labels: DataFrame, candidates: DataFrame, k: int = 100) -> DataFrame:
    """type, positives and negatives in the pool, negatives to a positive, and Recall@k of the pool."""
    stacked = F.stack(F.lit(3), F.lit(0), F.col("target_click"), F.lit(1), F.col("target_cart"), F.lit(2), F.col("target_order")).alias("type", "hit")
    pool = labelled.select(stacked).groupBy("type").agg(F.sum("hit").cast("long").alias("positives"), F.count_if(F.col("hit") == 0).alias("negatives"))
    pool = pool.select(F.col("type").cast("tinyint").alias("type"), "positives", "negatives", F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")).alias("neg_per_pos"))
    return pool.join(recall_at_k(labels, candidates, k).select("type", "recall"), "type", "left")
