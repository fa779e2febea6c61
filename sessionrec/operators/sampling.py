"""Labels of candidate rows, and sampling of negatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.weights import hash_draw
from sessionrec.operators.features import attach_item_features
from sessionrec.operators.selection import exact_quantile
from sessionrec.schema import HASH_RANGE

TARGETS = ("target_click", "target_cart", "target_order")


def label_candidates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate rows with the three targets, 0 where there is none."""
    return rows.join(targets.select("session", "aid", *TARGETS), ["session", "aid"], "left").na.fill(0, list(TARGETS))


def label_stats(rows: DataFrame) -> DataFrame:
    """bucket, rows and the sums of the targets; the row with a null bucket is the total."""
    return rows.rollup("bucket").agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TARGETS])


def with_total_row(stats: DataFrame, total: DataFrame, label: str = "part", name: str = "__TOTAL__") -> DataFrame:
    """Stats with a total row; columns that it lacks are null."""
    return stats.unionByName(total.withColumn(label, F.lit(name)), allowMissingColumns=True)


def hash_sample(rows: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose keys' hash falls into the fraction; the same keys always fare the same."""
    return rows.where(hash_draw(*map(F.col, keys), seed=seed) < int(fraction * HASH_RANGE))


def session_holdout(rows: DataFrame, mod: int = 10, rem: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, eval): sessions with session % mod = rem are for evaluation."""
    held = F.pmod("session", F.lit(mod)) == rem
    return rows.where(~held), rows.where(held)


def downsample_negatives(rows: DataFrame, target: str, per_positive: float = 20, seed: int = 42) -> DataFrame:
    """All positives, and negatives by hash so that there are about per_positive for each; none positive is an error."""
    counts = rows.agg(F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) != 1).alias("_neg"))
    checked = F.when(F.col("_pos") == 0, F.raise_error(F.lit(f"no row has {target} = 1")).cast("double")).otherwise(F.least(F.lit(1.0), F.lit(float(per_positive)) * F.col("_pos") / F.greatest("_neg", F.lit(1))))
    limit = counts.select(F.floor(checked * HASH_RANGE).alias("_limit"))
    kept = (F.col(target) == 1) | (hash_draw(F.col("session"), F.col("aid"), seed=seed) < F.col("_limit"))
    return rows.crossJoin(F.broadcast(limit)).where(kept).drop("_limit")


def sample_report(rows: DataFrame, target: str) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) != 1).alias("negatives"))
    return out.withColumn("neg_per_pos", F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")))


@dataclass(frozen=True)
class HardNegatives:
    """Which negatives are hard, and how many of each kind to keep for a positive."""

    target: str = "target_order"
    graph: str = "graph_w_cart_order_to_cart_order"
    quantile: float = 0.80
    min_clicks: int = 2
    hard_click: float = 8
    hard_graph: float = 8
    random: float = 4
    seed: int = 42


def graph_weight_threshold(rows: DataFrame, config: HardNegatives = HardNegatives()) -> DataFrame:
    """One row, threshold: the quantile (a value that occurs) of positive graph weights over negatives; 0 over none."""
    return rows.sparkSession.createDataFrame([(weight_threshold(rows, config),)], "threshold double")


def weight_threshold(rows: DataFrame, config: HardNegatives = HardNegatives()) -> float:
    """Found by exact counts of value ranges, pass by pass; the rows should be a table, since each pass reads them."""
    return exact_quantile(rows, F.when((F.col(config.target) == 0) & (F.col(config.graph) > 0), F.round(config.graph, 9)), config.quantile) or 0.0


def negative_bucket(config: HardNegatives, threshold: Column) -> Column:
    """positive, else hard_graph, else hard_click, else random."""
    weight = F.round(config.graph, 9)
    return F.when(F.col(config.target) == 1, "positive").when((weight > 0) & (weight >= threshold), "hard_graph").when(F.col("local_click_count") >= config.min_clicks, "hard_click").otherwise("random")


def with_negative_bucket(rows: DataFrame, config: HardNegatives = HardNegatives()) -> DataFrame:
    return rows.withColumn("negative_bucket", negative_bucket(config, F.lit(weight_threshold(rows, config))))


def negative_bucket_counts(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("negative_bucket").agg(F.count(F.lit(1)).alias("rows"))


def sampling_thresholds(counts: DataFrame, config: HardNegatives = HardNegatives()) -> DataFrame:
    """negative_bucket, limit: below which hash draw a row of the bucket stays (three rows, and one for positives)."""
    ratio = F.when(F.col("negative_bucket") == "hard_click", config.hard_click).when(F.col("negative_bucket") == "hard_graph", config.hard_graph).otherwise(config.random).cast("double")
    positives = counts.agg(F.coalesce(F.sum(F.when(F.col("negative_bucket") == "positive", F.col("rows"))), F.lit(0)).alias("_pos"))
    wanted = F.floor(F.col("_pos") * ratio).cast("double")
    share = F.least(F.lit(1.0), wanted / F.greatest(F.col("rows"), F.lit(1)))
    limit = F.when(F.col("negative_bucket") == "positive", F.lit(HASH_RANGE)).otherwise(F.floor(share * HASH_RANGE))
    return counts.crossJoin(F.broadcast(positives)).select("negative_bucket", limit.cast("long").alias("limit"))


def sample_hard_negatives(rows: DataFrame, config: HardNegatives = HardNegatives(), items: DataFrame | None = None) -> DataFrame:
    """All positives and negatives of each kind by their thresholds, with item features if given."""
    bucketed = with_negative_bucket(rows, config)
    return sample_by_limits(bucketed, sampling_thresholds(negative_bucket_counts(bucketed), config), config, items)


def sample_by_limits(bucketed: DataFrame, limits: DataFrame, config: HardNegatives = HardNegatives(), items: DataFrame | None = None) -> DataFrame:
    """Rows whose hash draw is below the limit of their kind (four rows), with item features if given."""
    drawn = hash_draw(F.col("session"), F.col("aid"), F.col("negative_bucket"), seed=config.seed)
    kept = bucketed.join(F.broadcast(limits), "negative_bucket").where(drawn < F.col("limit")).drop("limit")
    return kept if items is None else attach_item_features(kept, items)


def hard_negative_report(rows: DataFrame) -> DataFrame:
    """A row for each bucket of sessions (column bucket, as `part`) and __TOTAL__, which alone has neg_per_pos; one pass over the rows."""
    kinds = [F.count_if(F.col("negative_bucket") == b).alias(b) for b in ("positive", "hard_graph", "hard_click", "random")]
    out = rows.rollup("bucket").agg(F.grouping("bucket").alias("_all"), F.count(F.lit(1)).alias("rows"), *kinds)
    total = F.col("_all") == 1
    ratio = F.try_divide((F.col("rows") - F.col("positive")).cast("double"), F.col("positive").cast("double"))
    part = F.when(total, F.lit("__TOTAL__")).otherwise(F.col("bucket").cast("string"))
    return out.withColumn("part", part).withColumn("neg_per_pos", F.when(total, ratio)).drop("bucket", "_all")
