"""Item-to-item graphs from co-occurrence in sessions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.weights import decay_daily, decay_rational, degree_penalty, event_weight, target_value
from sessionrec.operators.windows import prune_topk, recent_seeds, recent_session_events
from sessionrec.schema import CART, CLICK, DAY_MS, ORDER
from sessionrec.sources.events import staged

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Rule:
    """How events of a session make edges: from source to target types, at most max_dt_ms later.

    max_events: how many of a session's newest events count; 0: all of them.
    """

    name: str
    sources: tuple[int, ...]
    targets: tuple[int, ...]
    max_dt_ms: int
    max_events: int = 30
    part_topk: int = 80
    topk: int = 20
    decay_seconds: float = 21_600.0
    alpha: float = 0.5
    weight: float = 1.0


# The three rules.
RULES = (
    Rule("click_to_click", (CLICK,), (CLICK,), 24 * HOUR_MS, decay_seconds=6 * 3600.0),
    Rule("cart_order_to_cart_order", (CART, ORDER), (CART, ORDER), 14 * DAY_MS, decay_seconds=7 * 86_400.0, weight=1.5),
    Rule("click_to_cart_order", (CLICK,), (CART, ORDER), 7 * DAY_MS, max_events=40, part_topk=100, decay_seconds=2 * 86_400.0, weight=2.0),
)


def item_frequency(events: DataFrame) -> DataFrame:
    return events.groupBy("aid").agg(F.count(F.lit(1)).alias("item_freq"))


def session_pairs(events: DataFrame) -> DataFrame:
    """session, aid_x, aid_y, type_y, dt: event pairs of a session, the second strictly later, of another item."""
    x = events.select("session", F.col("aid").alias("aid_x"), F.col("ts").alias("ts_x"))
    y = events.select("session", F.col("aid").alias("aid_y"), F.col("ts").alias("ts_y"), F.col("type").alias("type_y"))
    pairs = x.join(y, "session").where("aid_x <> aid_y and ts_x < ts_y")
    return pairs.select("session", "aid_x", "aid_y", "type_y", (F.col("ts_y") - F.col("ts_x")).alias("dt"))


def session_pairs_windowed(events: DataFrame, rule: Rule) -> DataFrame:
    """As session_pairs(), of the rule's types and within its time; types are chosen before the join."""
    x = events.where(F.col("type").isin(*rule.sources)).select("session", F.col("aid").alias("aid_x"), F.col("ts").alias("ts_x"))
    y = events.where(F.col("type").isin(*rule.targets)).select("session", F.col("aid").alias("aid_y"), F.col("ts").alias("ts_y"), F.col("type").alias("type_y"))
    pairs = x.join(y, "session").where((F.col("aid_x") != F.col("aid_y")) & (F.col("ts_y") > F.col("ts_x")) & (F.col("ts_y") - F.col("ts_x") <= rule.max_dt_ms))
    return pairs.select("session", "aid_x", "aid_y", "type_y", (F.col("ts_y") - F.col("ts_x")).alias("dt"))


def session_pairs_banded(events: DataFrame, rule: Rule) -> DataFrame:
    """As session_pairs_windowed(), for sessions of any length.

    Time is cut into bands as wide as the rule reaches. A pair's second event is in the band of the first or in the next one, so second
    events stand in two bands and rows join by session and band: a session costs its pairs within two bands, not its square,
    and its bands go to different tasks. A pair is found once, as the first event has one band.
    """
    band = F.floor(F.col("ts") / F.lit(rule.max_dt_ms))
    x = events.where(F.col("type").isin(*rule.sources)).select("session", band.alias("band"), F.col("aid").alias("aid_x"), F.col("ts").alias("ts_x"))
    y = events.where(F.col("type").isin(*rule.targets)).select("session", F.explode(F.array(band, band - 1)).alias("band"), F.col("aid").alias("aid_y"), F.col("ts").alias("ts_y"), F.col("type").alias("type_y"))
    pairs = x.join(y, ["session", "band"]).where((F.col("aid_x") != F.col("aid_y")) & (F.col("ts_y") > F.col("ts_x")) & (F.col("ts_y") - F.col("ts_x") <= rule.max_dt_ms))
    return pairs.select("session", "aid_x", "aid_y", "type_y", (F.col("ts_y") - F.col("ts_x")).alias("dt"))


def attach_degree_penalty(pairs: DataFrame, frequency: DataFrame, alpha: float) -> DataFrame:
    """Adds freq_x, freq_y (1 if unknown) and penalty. The join's kind is left to the planner, which knows the table's size."""
    x = frequency.select(F.col("aid").alias("aid_x"), F.col("item_freq").alias("freq_x"))
    y = frequency.select(F.col("aid").alias("aid_y"), F.col("item_freq").alias("freq_y"))
    out = pairs.join(x, "aid_x", "left").join(y, "aid_y", "left").na.fill(1, ["freq_x", "freq_y"])
    return out.withColumn("penalty", degree_penalty(F.col("freq_x"), F.col("freq_y"), alpha))


def rule_pair_sums(events: DataFrame, rule: Rule, by: tuple[str, ...] = ()) -> DataFrame:
    """aid_x, aid_y (and `by`): summed value and decay, before what depends on the two items alone. Events with a seed_rank are ranked already."""
    if rule.max_events == 0:
        pairs = session_pairs_banded(events, rule)
    else:
        recent = events.where(F.col("seed_rank") <= rule.max_events) if "seed_rank" in events.columns else recent_session_events(events, rule.max_events)
        pairs = session_pairs_windowed(recent, rule)
    if "bucket" in by:
        pairs = pairs.withColumn("bucket", F.pmod("session", F.lit(BUCKETS)))
    value = target_value(F.col("type_y")) * decay_rational(F.col("dt").cast("double") / 1000, rule.decay_seconds)
    return pairs.groupBy(*by, "aid_x", "aid_y").agg(F.sum(value).alias("mass"))


#: Buckets of sessions in the two-phase build.
BUCKETS = 16


def weighted(sums: DataFrame, frequency: DataFrame, rule: Rule) -> DataFrame:
    """Penalty and rule weight are factors of each pair's sum, so they are applied to it once, not to each event pair."""
    out = attach_degree_penalty(sums, frequency, rule.alpha)
    return out.withColumn("weight", F.col("mass") * F.col("penalty") * F.lit(rule.weight)).withColumn("graph", F.lit(rule.name))


def rule_edges(events: DataFrame, rule: Rule, frequency: DataFrame | None = None) -> DataFrame:
    """aid_x, aid_y, weight, graph: all edges of a rule. Frequencies are those of all events; of ranked events they must be given."""
    frequency = item_frequency(events) if frequency is None else frequency
    return weighted(rule_pair_sums(events, rule), frequency, rule).select("aid_x", "aid_y", "weight", "graph")


def union_graphs(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def rule_graph_topk(events: DataFrame, rules: Iterable[Rule] = RULES, alpha: float | None = None) -> DataFrame:
    """The exact graph: edges over all sessions, then the best of each item and rule."""
    graphs = []
    for edges, rule in rule_graphs(events, rules, alpha):
        graphs.append(prune_topk(edges, ["graph", "aid_x"], "weight", rule.topk, ["aid_y"]))
    return union_graphs(graphs)


def rule_graphs(events: DataFrame, rules: Iterable[Rule] = RULES, alpha: float | None = None) -> list[tuple[DataFrame, Rule]]:
    """All edges of each rule, with the rule. Events are ranked once, as deep as any rule looks, and items are counted once, for all of them."""
    rules = [rule if alpha is None else replace(rule, alpha=alpha) for rule in rules]
    most = max((rule.max_events for rule in rules), default=0)
    ranked = staged(recent_seeds(events, most), "ranked") if most else events
    frequency = staged(item_frequency(events), "frequency")
    return [(rule_edges(ranked if rule.max_events else events, rule, frequency), rule) for rule in rules]


def merge_edges(parts: DataFrame, topk: int) -> DataFrame:
    """Part edges summed and pruned again."""
    merged = parts.groupBy("graph", "aid_x", "aid_y").agg(F.sum("weight").alias("weight"))
    return prune_topk(merged, ["graph", "aid_x"], "weight", topk, ["aid_y"])


def rule_parts(events: DataFrame, rule: Rule) -> DataFrame:
    """Edges of each bucket of sessions, all of them: graph, bucket, aid_x, aid_y, weight."""
    sums = rule_pair_sums(events, rule, ("bucket",))
    return weighted(sums, item_frequency(events), rule).select("graph", "bucket", "aid_x", "aid_y", "weight")


def graph_topk_bucketed(events: DataFrame, rule: Rule) -> DataFrame:
    """The two-phase build: each bucket of sessions keeps its best edges, which are summed and pruned. It depends on BUCKETS."""
    pruned = prune_topk(rule_parts(events, rule), ["bucket", "aid_x"], "weight", rule.part_topk, ["aid_y"]).drop("rank")
    return merge_edges(pruned, rule.topk)


def covisitation_edges(events: DataFrame, max_events: int = 30) -> DataFrame:
    """aid_x, aid_y, weight: the single graph of all types."""
    pairs = session_pairs(recent_session_events(events, max_events))
    weight = event_weight(F.col("type_y")) * decay_daily(F.col("dt"))
    return pairs.groupBy("aid_x", "aid_y").agg(F.sum(weight).alias("weight"))


def undirected_covisitation(events: DataFrame, max_events: int = 30, topk: int = 40) -> DataFrame:
    """aid_x, aid_y, weight, rank: in how many sessions' recent events two items are together."""
    items = recent_session_events(events, max_events).select("session", "aid").distinct()
    pairs = items.select("session", F.col("aid").alias("aid_x")).join(items.select("session", F.col("aid").alias("aid_y")), "session").where("aid_x <> aid_y")
    counts = pairs.groupBy("aid_x", "aid_y").agg(F.count(F.lit(1)).alias("weight"))
    return prune_topk(counts, ["aid_x"], "weight", topk, ["aid_y"])
