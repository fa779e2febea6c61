"""Features of items, sessions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.weights import smoothed_rate
from sessionrec.operators.graph import RULES
from sessionrec.operators.retrieval import expand_seeds
from sessionrec.operators.windows import recent_seed_items
from sessionrec.schema import CART, CLICK, DAY_MS, DELTA_T_FILL, ORDER
from sessionrec.sources.events import staged

#: Strength of the prior of smoothed rates, and the least length of a session without purchase that counts as browsing.
PRIOR_STRENGTH, BROWSING_LENGTH = 50, 50


def _count(code: int) -> Column:
    return F.count_if(F.col("type") == code)


def item_features(events: DataFrame) -> DataFrame:
    """A row for each item: counts, counts of the last day and smoothed rates.

    The day's start is a one-row aggregate that is broadcast, as are the global rates.
    """
    day = events.agg((F.max("ts") - F.lit(DAY_MS)).alias("day"))
    counts = events.crossJoin(F.broadcast(day)).groupBy("aid").agg(
        F.count(F.lit(1)).alias("total_interactions"), _count(CLICK).alias("click_count"), _count(CART).alias("cart_count"), _count(ORDER).alias("order_count"),
        F.count_if(F.col("ts") >= F.col("day")).alias("recent_24h_interactions"),
    )
    counts = staged(counts, "item-counts")  # the rates of all items and of each one read it
    total = counts.agg(*[F.sum(c).cast("double").alias(f"_{c}") for c in ("click_count", "cart_count", "order_count")])
    clicks, carts = F.greatest(F.col("_click_count"), F.lit(1.0)), F.greatest(F.col("_cart_count"), F.lit(1.0))
    rate = lambda num, den, prior: smoothed_rate(num.cast("double"), den.cast("double"), prior, PRIOR_STRENGTH)
    click, cart, order = (F.col(c) for c in ("click_count", "cart_count", "order_count"))
    out = counts.crossJoin(F.broadcast(total)).select(
        "aid", "total_interactions", "click_count", "cart_count", "order_count", "recent_24h_interactions",
        rate(cart + order, click, (F.col("_cart_count") + F.col("_order_count")) / clicks).alias("conversion_rate"),
        rate(cart, click, F.col("_cart_count") / clicks).alias("item_cart_conversion_rate"),
        rate(order, click, F.col("_order_count") / clicks).alias("item_buy_conversion_rate"),
        rate(order, cart, F.col("_order_count") / carts).alias("item_cart_to_order_rate"),
    )
    return out.withColumn("item_funnel_dropoff_rate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("item_cart_to_order_rate"))))


def session_features(events: DataFrame) -> DataFrame:
    out = events.groupBy("session").agg(
        F.count(F.lit(1)).alias("session_length"), F.count_distinct("aid").alias("unique_items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        _count(CART).alias("cart_count"), _count(ORDER).alias("order_count"),
    )
    browsing = (F.col("session_length") >= BROWSING_LENGTH) & (F.col("cart_count") == 0) & (F.col("order_count") == 0)
    return out.withColumn("duration", F.col("last_ts") - F.col("first_ts")).withColumn("is_window_shopping", browsing.cast("tinyint"))


def local_item_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("session", "aid").agg(
        F.count(F.lit(1)).cast("int").alias("local_interaction_count"), _count(CLICK).cast("int").alias("local_click_count"), _count(CART).cast("int").alias("local_cart_count"),
        _count(ORDER).cast("int").alias("local_order_count"), F.max("ts").alias("item_last_ts"),
    )


def session_last_ts(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.max("ts").alias("session_last_ts"))


def events_for_candidates(events: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("session", "aid")) -> DataFrame:
    """Events of the candidates' keys only."""
    return events.join(candidates.select(*keys).distinct(), list(keys), "left_semi")


#: Words of 64 bits of a session's filter, and bits that a candidate sets in it. A session has some 100 candidates: about 3 in 100 others pass.
FILTER_WORDS, FILTER_HASHES = 16, 2


def _filter_bits(aid: Column) -> list[tuple[Column, Column]]:
    """(word, bit in the word) of an item, for each hash."""
    places = [F.pmod(F.xxhash64(aid.cast("long"), F.lit(k)), F.lit(64 * FILTER_WORDS)).cast("int") for k in range(FILTER_HASHES)]
    return [(F.floor(p / 64).cast("int"), p % 64) for p in places]


def session_filters(keys: DataFrame) -> DataFrame:
    """session, filter: a Bloom filter of each session's items, of FILTER_WORDS longs whatever their number, made of partial filters of tasks."""
    bits = _filter_bits(F.col("aid"))
    words = []
    for k in range(FILTER_WORDS):
        own = [F.when(word == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")) for word, bit in bits]
        words.append(F.bit_or(own[0].bitwiseOR(own[1])))
    return keys.groupBy("session").agg(F.array(*words).alias("filter"))


def may_hold(filter_: Column, aid: Column) -> Column:
    """Whether a session's filter may hold an item: always for its own, seldom for another."""
    tests = [F.call_function("shiftright", F.element_at(filter_, word + 1), bit).bitwiseAND(F.lit(1).cast("long")) == 1 for word, bit in _filter_bits(aid)]
    return tests[0] & tests[1]


def graph_signal_features(events: DataFrame, edges: DataFrame, max_seeds: int = 20, keys: DataFrame | None = None, filtered: bool = False) -> DataFrame:
    """A row for each session and neighbour of its distinct recent items: weights by graph and which graph prevails.

    dominant_graph_source is 3, 2 or 1 for click_to_cart_order, cart_order_to_cart_order and
    click_to_click, the greater number on ties, and 0 where all weights are 0. Without edges or
    seeds there are no rows, of the same columns. keys (session, aid): only these, chosen before sums are made. filtered: seeds then
    take a filter of their session's keys along to the graph, so that other neighbours go where they arise, before they are
    shuffled back to their sessions; the join removes those that pass by chance. That pays where seeds have many more neighbours
    than sessions have keys.
    """
    seeds = recent_seed_items(events, max_seeds)
    if keys is not None and filtered:
        signals = expand_seeds(seeds.join(session_filters(keys), "session"), edges, "filter").where(may_hold(F.col("filter"), F.col("aid"))).drop("filter")
    else:
        signals = expand_seeds(seeds, edges)
    if keys is not None:
        signals = signals.join(keys.select("session", "aid").distinct(), ["session", "aid"], "left_semi")
    weight, graph = F.col("weight"), F.col("graph")
    by_graph = [F.sum(F.when(graph == r.name, weight).otherwise(0.0)).alias(f"graph_w_{r.name}") for r in RULES]
    out = signals.groupBy("session", "aid").agg(F.sum(weight).alias("graph_weight_sum"), F.max(weight).alias("graph_weight_max"), F.count_distinct(graph).cast("int").alias("graph_source_count"), *by_graph)
    cc, coco, cco = (F.round(f"graph_w_{r.name}", 9) for r in RULES)
    dominant = F.when((cco >= cc) & (cco >= coco) & (cco > 0), 3).when((coco >= cc) & (coco > 0), 2).when(cc > 0, 1).otherwise(0)
    return out.withColumn("dominant_graph_source", dominant.cast("tinyint"))


def graph_signals_for_candidates(events: DataFrame, edges: DataFrame, candidates: DataFrame, max_seeds: int = 20, filtered: bool = False) -> DataFrame:
    """Graph signals of the candidates only; sessions without candidates are left out before the expansion."""
    sessions = candidates.select("session").distinct()
    return graph_signal_features(events.join(sessions, "session", "left_semi"), edges, max_seeds, candidates, filtered)


def interaction_features(candidates: DataFrame, events: DataFrame, edges: DataFrame, max_seeds: int = 20, fill: int = DELTA_T_FILL) -> DataFrame:
    """The 21 columns of a candidate row: what the session did with the item, and graph signals.

    Joins are on session or (session, aid); without a match counts and weights are 0 and
    delta_t_nan stays null.
    """
    out = candidates.select("session", "aid", F.col("score").alias("candidate_score"), F.col("rank").alias("candidate_rank"))
    out = out.join(local_item_stats(events), ["session", "aid"], "left").join(session_last_ts(events), "session", "left").join(graph_signals_for_candidates(events, edges, candidates, max_seeds), ["session", "aid"], "left")
    zero = [f"local_{x}_count" for x in ("interaction", "click", "cart", "order")] + ["graph_weight_sum", "graph_weight_max", "graph_source_count", *(f"graph_w_{r.name}" for r in RULES), "dominant_graph_source"]
    out = out.na.fill(0, zero).withColumn("delta_t_nan", F.col("session_last_ts") - F.col("item_last_ts"))
    return out.select(
        "session", "aid", "candidate_score", "candidate_rank", *zero[:4], (F.col("local_interaction_count") > 0).cast("tinyint").alias("is_repeated_item"), "session_last_ts", "item_last_ts",
        "delta_t_nan", F.coalesce("delta_t_nan", F.lit(fill).cast("long")).alias("delta_t_filled"), *zero[4:10], F.col("graph_weight_sum").alias("graph_weight_total"), "dominant_graph_source",
    )


#: Item columns that may be attached to candidate rows.
ITEM_COLUMNS = ("total_interactions", "click_count", "cart_count", "order_count", "recent_24h_interactions", "conversion_rate", "item_cart_conversion_rate", "item_buy_conversion_rate", "item_cart_to_order_rate", "item_funnel_dropoff_rate")


def attach_item_features(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with those of the known item columns that the table has; items without features get nulls."""
    return rows.join(items.select("aid", *[c for c in ITEM_COLUMNS if c in items.columns]), "aid", "left")
