"""Training and evaluation of a distributed ranker."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.functions.weights import hash_draw
from sessionrec.operators.boosting import BoostedTrees, Settings, train_boosted_trees
from sessionrec.operators.sampling import hash_sample, session_holdout
from sessionrec.operators.windows import prune_topk
from sessionrec.schema import HASH_RANGE

# The features of the click ranker beside the time since the last event on the item.
BASE_FEATURES = (
    "candidate_score", "candidate_rank", "local_interaction_count", "local_click_count", "local_cart_count", "local_order_count", "is_repeated_item", "graph_weight_sum", "graph_weight_max",
    "graph_source_count", "graph_w_click_to_click", "graph_w_cart_order_to_cart_order", "graph_w_click_to_cart_order", "graph_weight_total", "dominant_graph_source",
)
#: The column with the time since the last event on the item: unknown ones are missing, or a filled value.
DELTA_T = {"nan": "delta_t_nan", "filled": "delta_t_filled"}


def feature_names(variant: str) -> tuple[str, ...]:
    return (*BASE_FEATURES, DELTA_T[variant])


def ranker_frame(rows: DataFrame, target: str, *variants: str) -> DataFrame:
    """Keys, target and the features of the variants (none named: of all)."""
    return rows.select("session", "aid", target, *[F.col(c).cast("double").alias(c) for c in (*BASE_FEATURES, *(DELTA_T[v] for v in variants or DELTA_T))])


def ranker_training_frame(rows: DataFrame, target: str, *variants: str, mod: int = 10, rem: int = 0, session_fraction: float = 1.0, max_rows: int = 0, seed: int = 42) -> DataFrame:
    """Rows of the sessions that are not held out, or of a hash share of those: session_fraction, or the share that gives about max_rows (0: no limit)."""
    train, _ = session_holdout(rows, mod, rem)
    if session_fraction < 1.0:
        train = hash_sample(train, ["session"], session_fraction, seed)
    if max_rows > 0:
        share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        limit = train.agg(F.floor(share * HASH_RANGE).alias("_limit"))  # one row
        train = train.crossJoin(F.broadcast(limit)).where(hash_draw(F.col("session"), seed=seed) < F.col("_limit")).drop("_limit")
    return ranker_frame(train, target, *variants)


def train_click_ranker(frame: DataFrame, target: str, variant: str = "filled", settings: Settings = Settings()) -> BoostedTrees:
    """Boosted trees on the variant's features; where the time since the last event is missing, each split learns which way such rows go."""
    return train_boosted_trees(frame, target, feature_names(variant), ("session", "aid"), settings)


def feature_importance(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """feature, gain (shares that add up to 1) and splits (how many nodes of all trees split by it)."""
    gains, splits = Counter(), Counter()
    for tree in model.trees:
        for f, gain in zip(tree.feature, tree.gain):
            if f >= 0:
                gains[f] += gain
                splits[f] += 1
    total = sum(gains.values()) or 1.0
    return spark.createDataFrame([(n, gains[k] / total, splits[k]) for k, n in enumerate(model.features)], "feature string, gain double, splits long")


def train_and_save(training: DataFrame, held: DataFrame, target: str, path: str, variant: str = "filled", settings: Settings = Settings()) -> tuple[BoostedTrees, DataFrame, DataFrame]:
    """Trains, and writes model, importance (csv) and figures (json) below the path; the three as reread.

    Figures are one row: rows, positives and negatives of the training frame, and ranked_hit_recall() on the held-out rows.
    """
    spark = training.sparkSession
    train_click_ranker(training, target, variant, settings).save(spark, f"{path}/model")
    model = BoostedTrees.load(spark, f"{path}/model")
    importance = feature_importance(model, spark)
    importance.orderBy(F.desc("gain")).coalesce(1).write.option("header", True).csv(f"{path}/importance")
    scored = scored_rows(model, held, target)
    known = training.agg(F.count(F.lit(1)).alias("train_rows"), F.count_if(F.col(target) == 1).alias("train_positive_rows"), F.count_if(F.col(target) != 1).alias("train_negative_rows"))
    found = ranked_hit_recall(scored, target, "score").withColumnsRenamed({"rows": "eval_rows", "sessions": "eval_sessions", "positives": "eval_positive_rows", "top_rows": "top20_rows", "hits": "top20_hits", "recall": "recall_at_20"})
    figures = known.crossJoin(F.broadcast(found)).withColumn("model_path", F.lit(f"{path}/model")).withColumn("importance_path", F.lit(f"{path}/importance"))
    figures.coalesce(1).write.json(f"{path}/metrics")
    return (model, *saved_reports(spark, path))


def saved_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(importance, figures) as train_and_save() wrote them."""
    counts = ("train_rows", "train_positive_rows", "train_negative_rows", "eval_rows", "eval_sessions", "eval_positive_rows", "top20_rows", "top20_hits")
    figures = spark.read.schema(", ".join(f"{c} long" for c in counts) + ", recall_at_20 double").json(f"{path}/metrics")
    return spark.read.schema("feature string, gain double, splits long").option("header", True).csv(f"{path}/importance"), figures


def scored_rows(model: BoostedTrees, rows: DataFrame, target: str) -> DataFrame:
    return rows.select("session", "aid", target, model.score().alias("score"))


def score_and_rank(model: BoostedTrees, rows: DataFrame, target: str, topk: int = 20) -> DataFrame:
    """The best topk rows of each whole session by the model's score."""
    return prune_topk(scored_rows(model, rows, target), ["session"], "score", topk, ["aid"])


def ranked_hit_recall(rows: DataFrame, target: str, score: str = "candidate_score", topk: int = 20) -> DataFrame:
    """One row: hits in the best topk of each session over the positives in the pool."""
    pool = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session").alias("sessions"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("positives"))
    best = prune_topk(rows.select("session", "aid", target, score), ["session"], score, topk, ["aid"])
    best = best.agg(F.count(F.lit(1)).alias("top_rows"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("hits"))
    return pool.crossJoin(F.broadcast(best)).withColumn("recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("positives").cast("double")), F.lit(0.0)))
