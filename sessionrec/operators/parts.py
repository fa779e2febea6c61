"""Jobs that write their rows by buckets of sessions, with a stats file beside them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.operators.features import interaction_features
from sessionrec.operators.sampling import HardNegatives, negative_bucket, negative_bucket_counts, sample_by_limits, sampling_thresholds, weight_threshold
from sessionrec.sources.events import with_bucket, write_session_buckets

KINDS = ("positive", "hard_click", "hard_graph", "random")


def written_buckets(spark: SparkSession, path: str) -> list[int]:
    """The buckets that a folder has. A job's buckets appear when it commits, so one that is there is whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _stats(df: DataFrame, path: str) -> DataFrame:
    """Few rows as a csv with a header; as read again."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("emptyValue", "").csv(path)


def write_interaction_features(candidates: DataFrame, events: DataFrame, edges: DataFrame, path: str, buckets: int = 16, only: Iterable[int] | None = None, resume: bool = False) -> DataFrame:
    """Features of the candidates below path/parts, one folder for each bucket of sessions, and path/stats: bucket, rows of all that are there.

    only: just these buckets are made, from their candidates and events alone; others stay as they are.
    resume: buckets that are there are not made again, so a job that ended early goes on with the rest.
    """
    spark, parts = candidates.sparkSession, f"{path}/parts"
    wanted = set(range(buckets) if only is None else only) - set(written_buckets(spark, parts) if resume else ())
    if wanted:
        own = lambda df: with_bucket(df, buckets).where(F.col("bucket").isin(sorted(wanted))).drop("bucket")
        write_session_buckets(interaction_features(own(candidates), own(events), edges), parts, buckets, only=sorted(wanted))
    return _stats(spark.read.schema("session int, bucket int").parquet(parts).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).orderBy("bucket"), f"{path}/stats")


def write_hard_negatives(rows: DataFrame, path: str, config: HardNegatives = HardNegatives(), buckets: int = 16, items: DataFrame | None = None) -> DataFrame:
    """The sample of sample_hard_negatives() below path/parts, one folder for each bucket of sessions, and path/stats.

    Stats have a row for each part and __TOTAL__: rows of each kind, what the weight threshold and the kinds' hash limits were, and the ratio
    of negatives to positives (null without positives). Threshold and limits are those of all rows. The parts are counted as
    written, from two of their columns.
    """
    spark, parts = rows.sparkSession, f"{path}/parts"
    threshold = weight_threshold(rows, config)
    bucketed = rows.withColumn("negative_bucket", negative_bucket(config, F.lit(threshold)))
    limits = {r.negative_bucket: r.limit for r in sampling_thresholds(negative_bucket_counts(bucketed), config).collect()}  # four rows
    limit_rows = spark.createDataFrame([(k, limits.get(k, 0)) for k in KINDS], "negative_bucket string, limit long")
    write_session_buckets(sample_by_limits(bucketed, limit_rows, config, items), parts, buckets)
    kinds = [F.count_if(F.col("negative_bucket") == k).alias(f"{k}_rows") for k in KINDS]
    counts = spark.read.schema("negative_bucket string, bucket int").parquet(parts).rollup("bucket").agg(F.grouping("bucket").alias("_all"), *kinds, F.count(F.lit(1)).alias("rows"))
    negatives = F.col("rows") - F.col("positive_rows")
    counts = counts.select(
        F.when(F.col("_all") == 1, "__TOTAL__").otherwise(F.col("bucket").cast("string")).alias("part"), F.lit(threshold).alias("graph_threshold"),
        *[F.lit(limits.get(k, 0)).alias(f"threshold_{k}") for k in KINDS[1:]], *[f"{k}_rows" for k in KINDS], "rows", negatives.alias("negative_rows"),
        F.try_divide(negatives.cast("double"), F.col("positive_rows").cast("double")).alias("neg_pos_ratio"),
    )
    return _stats(counts.orderBy("part"), f"{path}/stats")
