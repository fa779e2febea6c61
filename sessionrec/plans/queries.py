"""Registered queries: each applies operators to events derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.functions import weights as W
from sessionrec.operators import features as feat
from sessionrec.operators import graph as G
from sessionrec.operators import heavy as H
from sessionrec.operators import metrics as M
from sessionrec.operators import parts as P
from sessionrec.operators import ranker as R
from sessionrec.operators import retrieval as ret
from sessionrec.operators import sampling as S
from sessionrec.operators import splits
from sessionrec.operators import submission as sub
from sessionrec.operators import windows as win
from sessionrec.operators.boosting import BoostedTrees
from sessionrec.operators.incremental import GraphState
from sessionrec.sources import events as src
from sessionrec.streaming import visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CC, COCO, CCO = G.RULES
#: Size of the candidate pool, and the number of candidates below which the popular list is added.
POOL, POOL_LEAST = 100, 50


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def users(spark, sf):
    return src.events_of_users(spark, sf)


def orders(spark, sf):
    return src.events_of_orders(spark, sf)


def r6(*names: str) -> list:
    """Doubles compared between engines have six decimals."""
    return [F.round(n, 6).alias(n) for n in names]


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(train events, label events). Both sides are one table by session, parsed and cut once; each reads its own files."""
    rows = src.staged_by_session(splits.with_side(users(spark, sf)), "events", side="side")
    return tuple(rows.where(F.col("side") == k).drop("side") for k in (splits.TRAIN, splits.LABEL))


def train_side(spark, sf):
    return sides(spark, sf)[0]


def edges_of(events: DataFrame) -> DataFrame:
    """The three rule graphs, pruned, as a table."""
    return src.staged(G.rule_graph_topk(events).select("aid_x", "aid_y", "weight", "graph"), "edges")


def pool_by(events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    edges = edges_of(events) if edges is None else edges
    return src.staged_by_session(ret.recommend_from_graphs(events, edges, topk=POOL, min_candidates=POOL_LEAST, popular=win.popular_fallback_items(events, POOL)), "pool")


def pool(spark, sf) -> DataFrame:
    """Candidates by the graphs of the train side, as a table."""
    return pool_by(train_side(spark, sf))


def features_of(events: DataFrame) -> DataFrame:
    edges = edges_of(events)
    return feat.interaction_features(pool_by(events, edges), events, edges)


def labelled(spark, sf) -> DataFrame:
    """Candidates with features and targets, as a table: thresholds, counts and samples read it several times."""
    return labelled_of(*sides(spark, sf))


def labelled_of(train: DataFrame, label: DataFrame) -> DataFrame:
    return src.staged_by_session(S.label_candidates(features_of(train), splits.label_targets(label)), "labelled")


def labelled_pool(spark, sf, *columns: str) -> DataFrame:
    """Candidates with targets, and no other features."""
    train, label = sides(spark, sf)
    candidates = pool_by(train)
    return S.label_candidates(candidates.select(*columns or candidates.columns), splits.label_targets(label))


# Sources and sinks


@query
def read_session_json(spark, sf):
    path = src.scratch_path(spark, "sessions.json")
    src.to_sessions(users(spark, sf)).write.json(path)
    return src.read_events(spark, path)


@query
def limit_sessions(spark, sf):
    return src.limit_sessions(orders(spark, sf), 100)


@query
def encode_event_type(spark, sf):
    return users(spark, sf).select("session", "ts", W.decode_type(F.col("type")).alias("name")).select("session", "ts", "name", W.encode_type(F.col("name")).alias("type"))


@query
def normalize_events(spark, sf):
    return orders(spark, sf)


@query
def read_events(spark, sf):
    path = src.scratch_path(spark, "events.csv")
    src.write_events(orders(spark, sf), path)
    return src.read_events(spark, path)


@query
def write_events(spark, sf):
    path = src.scratch_path(spark, "events.parquet")
    src.write_events(users(spark, sf), path)
    return src.read_events(spark, path)


@query
def compact_to_parquet(spark, sf):
    source, target = src.scratch_path(spark, "sessions.json"), src.scratch_path(spark, "events.parquet")
    src.to_sessions(orders(spark, sf)).write.json(source)
    src.compact_to_parquet(spark, source, target)
    return src.read_events(spark, target)


@query
def write_session_buckets(spark, sf):
    """Written in full, then two buckets anew; counted by bucket as read again."""
    path = src.scratch_path(spark, "buckets")
    src.write_session_buckets(orders(spark, sf), path, G.BUCKETS)
    src.write_session_buckets(orders(spark, sf), path, G.BUCKETS, only=(2, 3))
    return spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("aid").alias("aids"))


@query
def bucket_stats(spark, sf):
    events = users(spark, sf)
    recent = win.recent_session_events(events, CC.max_events).select("session", "type", F.lit(CC.name).alias("graph"), F.pmod("session", F.lit(G.BUCKETS)).alias("bucket"))
    parts = G.rule_parts(events, CC)
    pruned = win.prune_topk(parts, ["bucket", "aid_x"], "weight", 5, ["aid_y"])
    return src.bucket_stats({"rows_in": recent, "rows_built": parts, "rows_pruned": pruned})


@query
def sample_sessions(spark, sf):
    return src.sample_sessions(orders(spark, sf), 200)


# Expressions


@query
def event_weight(spark, sf):
    return users(spark, sf).groupBy("session").agg(F.sum(W.event_weight(F.col("type"))).alias("weight"))


@query
def target_value(spark, sf):
    return users(spark, sf).groupBy("session").agg(F.sum(W.target_value(F.col("type"))).alias("weight"))


def _recent_pairs(spark, sf):
    return G.session_pairs(win.recent_session_events(users(spark, sf), 30))


@query
def time_decay_rational(spark, sf):
    decay = W.decay_rational(F.col("dt").cast("double") / 1000, CC.decay_seconds)
    return _recent_pairs(spark, sf).groupBy("aid_x").agg(F.sum(decay).alias("decay")).select("aid_x", *r6("decay"))


@query
def time_decay_daily(spark, sf):
    return _recent_pairs(spark, sf).groupBy("aid_x").agg(F.sum(W.decay_daily(F.col("dt"))).alias("decay")).select("aid_x", *r6("decay"))


@query
def degree_penalty(spark, sf):
    f = G.item_frequency(orders(spark, sf))
    return f.select("aid", "item_freq", F.round(W.degree_penalty(F.col("item_freq"), F.col("item_freq") + 1, 0.5), 6).alias("penalty"))


@query
def smoothed_rate(spark, sf):
    items = orders(spark, sf).groupBy("aid").agg(F.count_if(F.col("type") == 0).alias("clicks"), F.count_if(F.col("type") == 2).alias("bought"))
    total = items.agg((F.sum("bought") / F.sum("clicks")).alias("prior"))
    return items.crossJoin(F.broadcast(total)).select("aid", F.round(W.smoothed_rate(F.col("bought").cast("double"), F.col("clicks").cast("double"), F.col("prior"), 50), 6).alias("rate"))


@query
def hash_sample_filter(spark, sf):
    return S.hash_sample(orders(spark, sf), ["session", "aid"], 0.25)


@query
def session_holdout(spark, sf):
    train, held = S.session_holdout(orders(spark, sf))
    return train.withColumn("side", F.lit("train")).unionByName(held.withColumn("side", F.lit("eval"))).groupBy("side", "session").agg(F.count(F.lit(1)).alias("rows"))


# Joins


@query
def session_pairs(spark, sf):
    return _recent_pairs(spark, sf)


@query
def session_pairs_windowed(spark, sf):
    return G.session_pairs_windowed(win.recent_session_events(orders(spark, sf), CCO.max_events), CCO)


@query
def session_pairs_banded(spark, sf):
    """Of whole sessions, not of their newest events."""
    return G.session_pairs_banded(orders(spark, sf), CCO)


@query
def attach_degree_penalty(spark, sf):
    events = orders(spark, sf)
    pairs = G.session_pairs_windowed(win.recent_session_events(events, COCO.max_events), COCO).groupBy("aid_x", "aid_y").agg(F.count(F.lit(1)).alias("pairs"))
    return G.attach_degree_penalty(pairs, G.item_frequency(events), COCO.alpha).select("aid_x", "aid_y", "pairs", "freq_x", "freq_y", *r6("penalty"))


@query
def expand_seeds(spark, sf):
    events = users(spark, sf)
    out = ret.expand_seeds(win.recent_seeds(events), edges_of(events)).groupBy("session", "aid", "graph").agg(F.count(F.lit(1)).alias("times"), F.sum("weight").alias("weight"))
    return out.select("session", "aid", "graph", "times", *r6("weight"))


@query
def fallback_cross(spark, sf):
    events = orders(spark, sf)
    return ret.fallback_cross(events.select("session").distinct(), win.popular_fallback_items(events, 20), 20, 60.0).select("session", "aid", *r6("score"))


@query
def events_for_candidates(spark, sf):
    events = train_side(spark, sf)
    return feat.events_for_candidates(events, pool_by(events))


@query
def graph_signals_for_candidates(spark, sf):
    events = train_side(spark, sf)
    edges = edges_of(events)
    out = feat.graph_signals_for_candidates(events, edges, pool_by(events, edges))
    return out.select("session", "aid", "graph_source_count", "dominant_graph_source", *r6("graph_weight_sum", "graph_weight_max"))


@query
def attach_item_features(spark, sf):
    events = train_side(spark, sf)
    items = feat.item_features(events).drop("cart_count", "conversion_rate")
    return feat.attach_item_features(pool_by(events).select("session", "aid"), items).select("session", "aid", "total_interactions", "order_count", *r6("item_buy_conversion_rate"))


@query
def label_candidates(spark, sf):
    return labelled_pool(spark, sf, "session", "aid")


# Aggregations


@query
def item_frequency(spark, sf):
    return G.item_frequency(orders(spark, sf))


@query
def merge_edges(spark, sf):
    parts = G.rule_parts(users(spark, sf), COCO)
    return G.merge_edges(parts, 20).select("graph", "aid_x", "aid_y", "rank", *r6("weight"))


@query
def local_item_stats(spark, sf):
    return feat.local_item_stats(orders(spark, sf))


@query
def session_last_ts(spark, sf):
    return feat.session_last_ts(orders(spark, sf))


GRAPH_COLUMNS = ("graph_weight_sum", "graph_weight_max", "graph_w_click_to_click", "graph_w_cart_order_to_cart_order", "graph_w_click_to_cart_order")


@query
def graph_signal_features(spark, sf):
    events = train_side(spark, sf)
    return feat.graph_signal_features(events, edges_of(events)).select("session", "aid", "graph_source_count", "dominant_graph_source", *r6(*GRAPH_COLUMNS))


@query
def candidate_pool_summary(spark, sf):
    return M.candidate_pool_summary(pool(spark, sf), POOL_LEAST, POOL)


@query
def graph_weight_threshold(spark, sf):
    return S.graph_weight_threshold(labelled(spark, sf)).select(*r6("threshold"))


@query
def negative_bucket_counts(spark, sf):
    return S.negative_bucket_counts(S.with_negative_bucket(labelled(spark, sf)))


@query
def label_stats(spark, sf):
    return S.label_stats(src.with_bucket(labelled_pool(spark, sf, "session", "aid"), 4))


# Windows and top-k


@query
def prune_topk(spark, sf):
    sums = orders(spark, sf).groupBy("session", "aid").agg(F.sum(W.event_weight(F.col("type"))).alias("score"))
    return win.prune_topk(sums, ["session"], "score", 5, ["aid"])


@query
def recent_session_events(spark, sf):
    return win.recent_session_events(orders(spark, sf), 30)


@query
def split_tail(spark, sf):
    train, labels = splits.split_tail(orders(spark, sf))
    train = train.groupBy("session").agg(F.count(F.lit(1)).alias("train_events"))
    return train.join(labels, "session", "full").select("session", "train_events", "type", F.array_join("ground_truth", " ").alias("ground_truth"))


@query
def recent_seeds(spark, sf):
    return win.recent_seeds(orders(spark, sf), 20)


@query
def recent_seed_items(spark, sf):
    return win.recent_seed_items(orders(spark, sf), 20)


@query
def recent_unique_items(spark, sf):
    return win.recent_unique_items(orders(spark, sf), 20)


@query
def popular_items(spark, sf):
    return win.popular_items(orders(spark, sf), 100)


@query
def popular_fallback_items(spark, sf):
    return win.popular_fallback_items(orders(spark, sf), 100)


@query
def heavy_items(spark, sf):
    """As popular_items(), by summaries of bounded size."""
    return H.heavy_items(orders(spark, sf), W.event_weight(F.col("type")), 100)


# Sets and strings


@query
def union_candidates(spark, sf):
    events = users(spark, sf)
    seeds = win.recent_seeds(events)
    graph = ret.expand_seeds(seeds, edges_of(events)).withColumnRenamed("weight", "score")
    return ret.union_candidates(ret.recent_scores(seeds, 60.0), graph).select("session", "aid", *r6("score"))


@query
def union_graphs(spark, sf):
    events = users(spark, sf)
    every = G.union_graphs(edges for edges, _ in G.rule_graphs(events))
    return every.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


@query
def with_total_row(spark, sf):
    rows = src.with_bucket(users(spark, sf), 8)
    parts = rows.groupBy(F.col("bucket").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("session").alias("sessions"))
    return S.with_total_row(parts, rows.agg(F.count(F.lit(1)).alias("rows")))


def _tail_labels(spark, sf):
    return splits.split_tail(users(spark, sf), held=3)


@query
def explode_labels(spark, sf):
    return M.explode_labels(_tail_labels(spark, sf)[1])


@query
def parse_labels(spark, sf):
    labels = _tail_labels(spark, sf)[1].select("session", "type", F.concat(F.lit("  "), F.array_join("ground_truth", "  "), F.lit(" ")).alias("text"))
    return labels.select("session", "type", M.parse_labels(F.col("text")).alias("items")).select("session", "type", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


def _single_graph_candidates(spark, sf, topk=20):
    train, _ = _tail_labels(spark, sf)
    edges = win.prune_topk(G.covisitation_edges(train), ["aid_x"], "weight", 20, ["aid_y"])
    return ret.recommend_from_edges(train, edges, topk=topk)


@query
def format_submission(spark, sf):
    return sub.format_submission(_single_graph_candidates(spark, sf))


@query
def predictions_for_metric(spark, sf):
    return sub.predictions_for_metric(_single_graph_candidates(spark, sf)).select("session", "type", F.array_join("labels", ",").alias("labels"))


# Graphs


@query
def covisitation_edges(spark, sf):
    return G.covisitation_edges(users(spark, sf)).select("aid_x", "aid_y", *r6("weight"))


def _rule_query(rule: G.Rule) -> Callable:
    def run(spark, sf):
        return G.rule_edges(orders(spark, sf), rule).select("aid_x", "aid_y", "graph", *r6("weight"))

    return run


for _rule in G.RULES:
    QUERIES[f"rule_edges_{_rule.name}"] = _rule_query(_rule)


@query
def rule_edges_whole_sessions(spark, sf):
    return G.rule_edges(orders(spark, sf), replace(CCO, max_events=0)).select("aid_x", "aid_y", "graph", *r6("weight"))


@query
def rule_graph_topk(spark, sf):
    return G.rule_graph_topk(users(spark, sf)).select("aid_x", "aid_y", "graph", "rank", *r6("weight"))


def _batches(events: DataFrame, n: int = 3) -> list[DataFrame]:
    """Events cut into n stretches of time."""
    ends = events.agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))  # one row
    k = F.floor((F.col("ts") - F.col("_low")) * n / (F.col("_high") - F.col("_low") + 1))
    rows = src.staged(events.crossJoin(F.broadcast(ends)).withColumn("batch", k).drop("_low", "_high"), "batches")
    return [rows.where(F.col("batch") == i).drop("batch") for i in range(n)]


def _grown(spark, sf) -> tuple[GraphState, list[DataFrame]]:
    state = GraphState(spark, src.scratch_path(spark, "graph"))
    return state, [state.update(batch) for batch in _batches(users(spark, sf))]


@query
def rule_graph_incremental(spark, sf):
    """The graph of all events, built from three batches, one after another."""
    return _grown(spark, sf)[0].graph_topk().select("aid_x", "aid_y", "graph", "rank", *r6("weight"))


@query
def rule_graph_update_report(spark, sf):
    """What each of the batches made the graph look at again."""
    reports = [r.withColumn("batch", F.lit(k)) for k, r in enumerate(_grown(spark, sf)[1])]
    return reduce(DataFrame.unionByName, reports).select("batch", "new_events", "sessions", "old_events", "all_pairs")


@query
def flagship_click_graph(spark, sf):
    return G.rule_graph_topk(users(spark, sf), [CC]).select("aid_x", "aid_y", "rank", *r6("weight"))


@query
def graph_topk_bucketed(spark, sf):
    return G.graph_topk_bucketed(users(spark, sf), COCO).select("aid_x", "aid_y", "rank", *r6("weight"))


@query
def undirected_covisitation(spark, sf):
    return G.undirected_covisitation(users(spark, sf))


# Retrieval


@query
def recommend_from_edges(spark, sf):
    return _single_graph_candidates(spark, sf).select("session", "aid", "rank", *r6("score"))


@query
def recommend_from_graphs(spark, sf):
    return pool(spark, sf).select("session", "aid", "rank", *r6("score"))


@query
def recommend_mixed(spark, sf):
    events = users(spark, sf)
    return ret.recommend_mixed(events, topk=20, sessions=events.select("session").distinct())


# Splits and metrics


@query
def split_time_axis(spark, sf):
    feature_events, label_events = splits.split_time(users(spark, sf))
    kept = feature_events.groupBy("session").agg(F.count(F.lit(1)).alias("feature_events"))
    labels = splits.grouped_labels(label_events).select("session", "type", F.array_join("ground_truth", " ").alias("ground_truth"))
    return kept.join(labels, "session", "full").select("session", "feature_events", "type", "ground_truth")


@query
def label_targets(spark, sf):
    return splits.label_targets(sides(spark, sf)[1])


@query
def split_audit(spark, sf):
    return splits.split_audit(*sides(spark, sf))


@query
def recall_at_k_capped(spark, sf):
    labels = _tail_labels(spark, sf)[1].withColumn("type", W.decode_type(F.col("type")))
    return M.recall_at_k_capped(labels, sub.predictions_for_metric(_single_graph_candidates(spark, sf))).select(*r6("weighted_recall"))


@query
def recall_at_k(spark, sf):
    return M.recall_at_k(_tail_labels(spark, sf)[1], _single_graph_candidates(spark, sf)).select("type", "total", "hits", *r6("recall", "metric_weight", "weighted_recall"))


@query
def candidate_coverage(spark, sf):
    train, label = sides(spark, sf)
    labels, candidates = splits.grouped_labels(label), pool_by(train)
    rows = S.label_candidates(candidates.select("session", "aid"), splits.label_targets(label))
    return M.candidate_coverage(rows, labels, candidates, POOL).select("type", "positives", "negatives", *r6("neg_per_pos", "recall"))


# Features


RATES = ("conversion_rate", "item_cart_conversion_rate", "item_buy_conversion_rate", "item_cart_to_order_rate", "item_funnel_dropoff_rate")


@query
def item_features(spark, sf):
    events = src.staged(orders(spark, sf).select("aid", "ts", "type"), "events")  # joined once: the last day and the counts read it
    return feat.item_features(events).select("aid", "total_interactions", "click_count", "cart_count", "order_count", "recent_24h_interactions", *r6(*RATES))


@query
def session_features(spark, sf):
    return feat.session_features(orders(spark, sf))


@query
def interaction_features(spark, sf):
    out = features_of(train_side(spark, sf))
    doubles = {"candidate_score", "graph_weight_total", *GRAPH_COLUMNS}
    return out.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in out.columns])


@query
def visit_features(spark, sf):
    return visits.visit_features(orders(spark, sf), "7 days")


@query
def visit_features_stream(spark, sf):
    """From a stream of files that are out of order: each has events of all times. A last file moves the watermark past all visits."""
    events, gap = src.staged(users(spark, sf), "events"), 86_400_000
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    folder, target, checkpoint = (src.scratch_path(spark, name) for name in ("stream", "visits", "checkpoint"))
    for k in range(3):
        src.write_events(events.where(F.pmod(F.xxhash64("session", "aid", "ts"), F.lit(3)) == k), f"{folder}/{k}.parquet")
    delay = high - low + gap
    src.write_events(events.limit(1).select(F.lit(-1).alias("session"), "aid", F.lit(high + delay + 2 * gap).alias("ts"), "type"), f"{folder}/last.parquet")
    schema = visits.visit_features(events).schema
    visits.write_visits(spark, f"{folder}/*.parquet", target, checkpoint, f"{gap} milliseconds", f"{delay} milliseconds", files=8)
    return spark.read.schema(schema).parquet(target).where("session >= 0")


# Sampling and ranking


@query
def downsample_negatives(spark, sf):
    return S.downsample_negatives(labelled_pool(spark, sf), "target_click").select("session", "aid", "target_click")


@query
def negative_bucket(spark, sf):
    return S.with_negative_bucket(labelled(spark, sf), S.HardNegatives(target="target_click")).select("session", "aid", "negative_bucket")


@query
def sampling_thresholds(spark, sf):
    config = S.HardNegatives(target="target_click")
    return S.sampling_thresholds(S.negative_bucket_counts(S.with_negative_bucket(labelled(spark, sf), config)), config)


@query
def sample_hard_negatives(spark, sf):
    config = S.HardNegatives(target="target_click")
    train, label = sides(spark, sf)
    return S.sample_hard_negatives(labelled_of(train, label), config, feat.item_features(train)).select("session", "aid", "negative_bucket", "total_interactions")


@query
def hard_negative_report(spark, sf):
    return S.hard_negative_report(src.with_bucket(S.with_negative_bucket(labelled(spark, sf), S.HardNegatives(target="target_click")), 4)).select("part", "rows", "positive", "hard_graph", "hard_click", "random", *r6("neg_per_pos"))


@query
def write_hard_negatives(spark, sf):
    """The stats beside the written parts."""
    train, label = sides(spark, sf)
    out = P.write_hard_negatives(labelled_of(train, label), src.scratch_path(spark, "negatives"), S.HardNegatives(target="target_click"), 4, feat.item_features(train))
    return out.select(*[c for c in out.columns if c not in ("graph_threshold", "neg_pos_ratio")], *r6("graph_threshold", "neg_pos_ratio"))


@query
def write_interaction_features(spark, sf):
    """Three buckets first, then the rest by resuming; sums of the parts as read again."""
    events, path = train_side(spark, sf), src.scratch_path(spark, "features")
    edges = edges_of(events)
    candidates = pool_by(events, edges)
    P.write_interaction_features(candidates, events, edges, path, 8, only=(1, 4, 6))
    stats = P.write_interaction_features(candidates, events, edges, path, 8, resume=True)
    parts = spark.read.parquet(f"{path}/parts").groupBy("bucket").agg(F.sum("aid").alias("aids"), F.sum("local_interaction_count").alias("interactions"), F.sum("dominant_graph_source").alias("dominant"))
    return stats.join(parts, "bucket").select("bucket", "rows", "aids", "interactions", "dominant")


@query
def ranker_training_frame(spark, sf):
    out = R.ranker_training_frame(labelled(spark, sf), "target_click")
    return out.withColumn("delta_t_known", F.col("delta_t_nan").isNotNull().cast("double")).select("session", "aid", "target_click", "delta_t_known", "delta_t_filled", *r6("candidate_score", "graph_weight_total"))


#: Where the models of an application and its tables are, by delta_t variant, and the held-out rows.
_TRAINED: dict[tuple[str, str], tuple[dict[str, str], DataFrame]] = {}


def _models(spark, sf) -> tuple[dict[str, str], DataFrame]:
    """For each delta_t variant the place of a saved model with its reports, and the held-out sessions' rows. They are trained once for an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED or not all(src.is_scratch(spark, path) for path in _TRAINED[key][0].values()):
        rows = labelled(spark, sf)
        training = src.staged(S.downsample_negatives(R.ranker_training_frame(rows, "target_click"), "target_click"), "training")
        held = src.staged(R.ranker_frame(S.session_holdout(rows)[1], "target_click"), "held")
        paths = {v: src.scratch_path(spark, f"ranker-{v}") for v in R.DELTA_T}
        with ThreadPoolExecutor(len(paths)) as pool_of_jobs:  # small models are trained in a task each, so both at once
            for job in [pool_of_jobs.submit(R.train_and_save, training, held, "target_click", path, v) for v, path in paths.items()]:
                job.result()
        _TRAINED[key] = paths, held
    return _TRAINED[key]


@query
def train_click_ranker(spark, sf):
    """Gains and splits of the features of each variant's model, and how the model fares on held-out sessions."""
    parts = []
    for v, path in _models(spark, sf)[0].items():
        importance, figures = R.saved_reports(spark, path)
        parts.append(importance.crossJoin(F.broadcast(figures)).withColumn("variant", F.lit(v)))
    return reduce(DataFrame.unionByName, parts)


@query
def score_and_rank(spark, sf):
    """The best rows of each held-out session by the model of each delta_t variant."""
    paths, held = _models(spark, sf)
    return reduce(DataFrame.unionByName, (R.score_and_rank(BoostedTrees.load(spark, f"{path}/model"), held, "target_click").withColumn("variant", F.lit(v)) for v, path in paths.items()))


@query
def ranked_hit_recall(spark, sf):
    return R.ranked_hit_recall(labelled_pool(spark, sf), "target_click", "score").select("rows", "sessions", "positives", "top_rows", "hits", *r6("recall"))
