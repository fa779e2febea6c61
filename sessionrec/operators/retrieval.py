"""Candidate retrieval for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.operators.graph import undirected_covisitation
from sessionrec.operators.windows import popular_items, prune_topk, recent_seeds, recent_unique_items
from sessionrec.sources.events import staged, staged_by_session

#: More than the items of any list.
PLACES = 2**30


def dealt_for_expansion(rows: DataFrame) -> DataFrame:
    """The rows, dealt by session to as many tasks as a shuffle has: they are few bytes but expand to many rows, so adaptive execution must not
    join them to few tasks by their size. The hash makes it a shuffle of its own, which isn't left out where rows have been dealt by session."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("session"))


def expand_seeds(seeds: DataFrame, edges: DataFrame, *carried: str) -> DataFrame:
    """session, aid, weight (and graph): the seeds' neighbours, once for each seed row; columns of the seeds may be carried along."""
    keep = [c for c in ("weight", "graph") if c in edges.columns]
    return seeds.select("session", F.col("aid").alias("aid_x"), *carried).join(edges.select("aid_x", "aid_y", *keep), "aid_x").select("session", F.col("aid_y").alias("aid"), *keep, *carried)


def union_candidates(*parts: DataFrame) -> DataFrame:
    """session, aid, score: scores of all parts, summed."""
    out = parts[0].select("session", "aid", "score")
    for part in parts[1:]:
        out = out.unionByName(part.select("session", "aid", "score"))
    return out.groupBy("session", "aid").agg(F.sum("score").alias("score"))


def recent_scores(seeds: DataFrame, recent_weight: float) -> DataFrame:
    return seeds.select("session", "aid", (F.lit(float(recent_weight)) / F.col("seed_rank")).alias("score"))


def recommend_from_edges(events: DataFrame, edges: DataFrame, topk: int = 20, max_seeds: int = 20, recent_weight: float = 50.0) -> DataFrame:
    """session, aid, score, rank: recent items and their neighbours."""
    seeds = recent_seeds(events, max_seeds)
    graph = expand_seeds(seeds, edges).withColumnRenamed("weight", "score")
    return prune_topk(union_candidates(recent_scores(seeds, recent_weight), graph), ["session"], "score", topk, ["aid"])


def fallback_cross(sessions: DataFrame, popular: DataFrame, topk: int, recent_weight: float) -> DataFrame:
    """Each session with the popular list, which has topk rows at most."""
    listed = popular.where(F.col("rank") <= topk).select("aid", (F.lit(recent_weight * 0.01) / F.col("rank")).alias("score"))
    return sessions.crossJoin(F.broadcast(listed)).select("session", "aid", "score")


def sparse_sessions(scores: DataFrame, topk: int, least: int) -> DataFrame:
    """Sessions with fewer than `least` candidates among their best topk."""
    counts = scores.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.least("n", F.lit(topk)) < least).select("session")


def recommend_from_graphs(events: DataFrame, edges: DataFrame, topk: int = 20, min_candidates: int = 20, max_seeds: int = 20, recent_weight: float = 60.0, popular: DataFrame | None = None) -> DataFrame:
    """As recommend_from_edges() over several graphs. Sessions with too few candidates also get the
    popular list, whose scores add to those there; the best topk stay."""
    scores = recommend_scores(events, edges, max_seeds, recent_weight)
    if popular is not None and min_candidates > 0:
        # The counts and the sums both read the scores: as a table by session they are expanded once, and are met by session again.
        scores = staged_by_session(scores, "scores")
        scores = union_candidates(scores, fallback_cross(sparse_sessions(scores, topk, min_candidates), popular, topk, recent_weight))
    return prune_topk(scores, ["session"], "score", topk, ["aid"])


def recommend_scores(events: DataFrame, edges: DataFrame, max_seeds: int, recent_weight: float) -> DataFrame:
    seeds = recent_seeds(events, max_seeds)
    return union_candidates(recent_scores(seeds, recent_weight), expand_seeds(seeds, edges).withColumnRenamed("weight", "score"))


def recommend_mixed(events: DataFrame, sessions: DataFrame | None = None, topk: int = 20, covisitation_topk: int = 40) -> DataFrame:
    """session, aid, rank: recent items, then each one's co-visited items, then popular ones; the first
    place of an item counts. A session without events gets the popular items."""
    recent = recent_unique_items(events, topk)
    if sessions is not None:
        recent = recent.join(sessions, "session", "left_semi")
    everyone = recent.select("session").distinct() if sessions is None else sessions.select("session").distinct()
    recent, everyone = dealt_for_expansion(recent), dealt_for_expansion(everyone)
    # As a table its size is known: small lists are broadcast, and sessions stay as they are dealt.
    around = staged(undirected_covisitation(events, topk=covisitation_topk), "around")
    # A place is a stage and two numbers in it, in one long: its least value is kept by hash, without a sort.
    place = lambda stage, a, b: (F.lit(stage * PLACES**2) + a.cast("long") * PLACES + b.cast("long")).alias("place")
    none = F.lit(0)
    expanded = recent.withColumnRenamed("aid", "aid_x").join(around, "aid_x").select("session", F.col("aid_y").alias("aid"), place(1, F.col("pos"), F.col("rank")))
    popular = everyone.crossJoin(F.broadcast(popular_items(events, topk).select("aid", "rank"))).select("session", "aid", place(2, none, F.col("rank")))
    every = recent.select("session", "aid", place(0, none, F.col("pos"))).unionByName(expanded).unionByName(popular)
    first = every.groupBy("session", "aid").agg(F.min("place").alias("place"))
    order = Window.partitionBy("session").orderBy("place")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topk).select("session", "aid", "rank")
