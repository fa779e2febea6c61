"""Reading, writing and sampling of session events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.functions.weights import decode_type, encode_type, key_hash
from sessionrec.operators.selection import least_keys
from sessionrec.schema import EVENTS, SESSION_JSON


def normalize_events(df: DataFrame) -> DataFrame:
    """The four event columns with their types. A value out of range is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS])


def flatten_sessions(sessions: DataFrame, strict: bool = True) -> DataFrame:
    """Session documents to events; a session without events gives none."""
    flat = sessions.select("session", F.explode("events").alias("e")).select("session", "e.aid", "e.ts", encode_type(F.col("e.type"), strict).alias("type"))
    return normalize_events(flat)


def read_session_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of a file of session documents, one to a line; blank lines are skipped."""
    return flatten_sessions(spark.read.schema(SESSION_JSON).json(path).where("session is not null"), strict)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a parquet, csv (with a header) or json source, told by the path's suffix."""
    suffix = path.rstrip("/").rpartition(".")[2]
    if suffix == "parquet":
        return normalize_events(spark.read.parquet(path))
    if suffix == "csv":
        return spark.read.schema(EVENTS).option("header", True).csv(path)
    if suffix in ("json", "jsonl"):
        return read_session_json(spark, path)
    raise ValueError(f"neither parquet, csv nor json: {path}")


def write_events(events: DataFrame, path: str, mode: str = "error") -> None:
    suffix = path.rstrip("/").rpartition(".")[2]
    if suffix == "parquet":
        events.write.mode(mode).parquet(path)
    elif suffix == "csv":
        events.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"neither parquet nor csv: {path}")


def to_sessions(events: DataFrame) -> DataFrame:
    """Session documents with events in time order and types by name."""
    item = F.struct("ts", "aid", decode_type(F.col("type")).alias("type"))
    ordered = F.array_sort(F.collect_list(item))
    return events.groupBy(F.col("session").cast("long").alias("session")).agg(F.transform(ordered, lambda e: F.struct(e["aid"].alias("aid"), e["ts"].alias("ts"), e["type"].alias("type"))).alias("events"))


def compact_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    """Session documents to a typed table; rows of a file are in session and time order."""
    read_session_json(spark, source).repartition("session").sortWithinPartitions("session", "ts").write.parquet(target)


def limit_sessions(events: DataFrame, n: int) -> DataFrame:
    """All events of the n smallest session ids."""
    return events.join(events.select("session").distinct().orderBy("session").limit(n), "session", "left_semi")


def sample_sessions(events: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All events of n sessions drawn evenly by a hash of their id and the seed: those of the n least hashes."""
    code = key_hash(F.col("session"), seed=seed)
    return events.where(least_keys(events, code, F.col("session"), n))


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod("session", F.lit(buckets)))


def write_session_buckets(df: DataFrame, path: str, buckets: int, only: Iterable[int] | None = None, parts: int | None = None) -> None:
    """One folder for each bucket of sessions; with `only`, just these are written anew.

    A bucket is written by `parts` tasks, each with whole sessions; by default so many that all buckets
    take as many tasks as a shuffle has.
    """
    rows = with_bucket(df, buckets)
    written = list(range(buckets) if only is None else only)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(written))
    parts = parts or -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(written)))
    rows = rows.repartition(max(1, len(written)) * parts, "bucket", F.pmod(F.xxhash64("session"), F.lit(parts)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def bucket_stats(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each graph and bucket after each stage, one column to a stage."""
    out = None
    for name, df in stages.items():
        counts = df.groupBy("graph", "bucket").agg(F.count(F.lit(1)).alias(name))
        out = counts if out is None else out.join(counts, ["graph", "bucket"], "full")
    return out.na.fill(0, list(stages))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session sets for checkpoints; a temporary one where a local run sets none.

    On a cluster a folder must be set: executors don't see each other's disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(base)
    path = f"{base}/{uuid.uuid4().hex}-{name}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def is_scratch(spark: SparkSession, path: str) -> bool:
    """Whether this application got the place from scratch_path() and has not cleared it."""
    return path in _made.get(spark.sparkContext.applicationId, [])


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to scratch_path(): for when results are written or collected, as lazy ones read it."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_checkpoints(spark: SparkSession) -> None:
    """Sets a folder for checkpoints where none is set; a folder that is set stays."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_path(spark, "checkpoints"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: a stage that several later ones read is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: dict[str, list[str]] = {}


def staged_by_session(df: DataFrame, name: str, buckets: int | None = None, side: str | None = None) -> DataFrame:
    """The rows as a written table, bucketed and sorted by session: groups, windows and joins of such tables by session, or
    by session and more, need no shuffle. buckets: by default as many as a shuffle has partitions; tables meet without a
    shuffle if they have equally many. side: a column of few values, each of which has files of its own.

    A join by more than the session goes by the session's buckets only if
    spark.sql.requireAllClusterKeysForCoPartition is false. Results are lazy, so the session keeps that setting.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"staged_{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    writer = df.repartition(buckets, "session").write.bucketBy(buckets, "session").sortBy("session").option("path", path)
    (writer.partitionBy(side) if side else writer).saveAsTable(table)
    return spark.table(table)


def events_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the `events` table, all of them: a session for each user, the number in props as the item.

    Purchases are orders and signups are carts; every other type (view, click, error) is a contact with the item, so a click.
    """
    code = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return normalize_events(rows.select(F.col("user_id").alias("session"), F.regexp_extract("props", "([0-9]+)", 1).alias("aid"), millis("ts").alias("ts"), code.alias("type")))


def events_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of `orders` and `lineitem`: a session for each customer, parts as items, days as times (with ties)."""
    code = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    # Orders are a quarter of the lines and have one row to a key: a table of them by hash takes less of a task's memory than sorts of both sides.
    rows = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return normalize_events(rows.select(F.col("o_custkey").alias("session"), F.col("l_partkey").alias("aid"), millis("l_shipdate").alias("ts"), code.alias("type")))


def millis(column: str) -> Column:
    """Milliseconds of a time without zone, taken as UTC whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")) / F.lit(1000)).cast("long")
