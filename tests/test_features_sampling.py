import random

import pytest
from conftest import events, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionrec.operators import features, ranker, sampling


# The toy rows of this module and what is expected of them.
@pytest.fixture(scope="module")
def toy(spark):
    return events(spark, [1, 1, 1, 2, 2, 3, 3, 3], [10, 10, 10, 11, 12, 12, 12, 12], [1000 * k for k in range(1, 9)], [0, 0, 0, 0, 0, 1, 1, 2])


def test_item_features(toy):
    found = {r.aid: r for r in features.item_features(toy).collect()}
    assert found[10].total_interactions == 3 and found[12].recent_24h_interactions == 4
    assert found[10].conversion_rate == pytest.approx(30 / 53) and found[12].item_cart_conversion_rate == pytest.approx(22 / 51)
    assert found[11].item_buy_conversion_rate == pytest.approx(10 / 51) and found[12].item_funnel_dropoff_rate == pytest.approx(0.5)


def test_session_features(spark, toy):
    assert rows(features.session_features(toy), "session", "session_length", "unique_items", "duration", "cart_count", "order_count", "is_window_shopping") == [(1, 3, 1, 2000, 0, 0, 0), (2, 2, 2, 1000, 0, 0, 0), (3, 3, 1, 2000, 2, 1, 0)]
    browsing = events(spark, [1] * 50, list(range(50)), list(range(50)), [0] * 50)
    assert features.session_features(browsing).first().is_window_shopping == 1


def test_interaction_features(spark):
    candidates = spark.createDataFrame([(1, 10, 1.0, 1), (1, 20, 0.5, 2)], "session int, aid int, score double, rank int")
    seen = events(spark, [1, 1], [10, 11], [1000, 5000], [0, 1])
    edges = spark.createDataFrame([(11, 20, 0.75, "click_to_cart_order")], "aid_x int, aid_y int, weight double, graph string")
    a, b = features.interaction_features(candidates, seen, edges).orderBy("aid").collect()
    assert (a.is_repeated_item, a.local_click_count, a.delta_t_nan, a.delta_t_filled) == (1, 1, 4000, 4000)
    assert (b.is_repeated_item, b.delta_t_nan, b.delta_t_filled, b.graph_weight_total, b.graph_source_count, b.dominant_graph_source) == (0, None, 9_999_999, 0.75, 1, 3)
    assert len(a) == 21
    none = features.interaction_features(candidates, seen, edges.limit(0)).collect()
    assert all(r.graph_weight_sum == 0 and r.dominant_graph_source == 0 for r in none)


@pytest.fixture(scope="module")
def ranked(spark):
    data = zip([1, 1, 1, 2, 2, 2, 3, 3], [10, 11, 12, 10, 13, 14, 15, 16], [0, 3, 1, 2, 0, 1, 4, 0], [0.0, 0.1, 0.9, 0.0, 0.8, 0.0, 0.2, 0.0], [1, 0, 0, 1, 0, 0, 0, 0])
    return spark.createDataFrame(list(data), "session int, aid int, local_click_count int, graph_w_cart_order_to_cart_order double, target_order int")


def test_hard_negatives(ranked):
    config = sampling.HardNegatives(quantile=0.5, hard_click=1, hard_graph=1, random=1)
    assert sampling.graph_weight_threshold(ranked, config).first()[0] == 0.2
    kinds = dict(((r.session, r.aid), r.negative_bucket) for r in sampling.with_negative_bucket(ranked, config).collect())
    assert kinds == {(1, 10): "positive", (2, 10): "positive", (2, 14): "random", (3, 16): "random", (1, 11): "hard_click", (1, 12): "hard_graph", (2, 13): "hard_graph", (3, 15): "hard_graph"}
    kept = sampling.sample_hard_negatives(ranked, config)
    assert rows(kept.where("target_order = 1"), "session", "aid") == [(1, 10), (2, 10)]
    report = sampling.hard_negative_report(kept.withColumn("bucket", F.lit(0)))
    assert report.where("part = '__TOTAL__'").first().positive == 2
    assert sampling.graph_weight_threshold(ranked.limit(0), config).first()[0] == 0.0


def test_downsampling(spark):
    rows_ = spark.range(10_000).select((F.col("id") % 100).cast("int").alias("session"), F.col("id").cast("int").alias("aid"), (F.col("id") < 100).cast("int").alias("target_click"))
    kept = sampling.downsample_negatives(rows_, "target_click", per_positive=20)
    counts = sampling.sample_report(kept, "target_click").first()
    assert counts.positives == 100 and 1700 < counts.negatives < 2300
    with pytest.raises(PySparkException):
        sampling.downsample_negatives(rows_.where("target_click = 0"), "target_click").collect()


def test_recall_of_ranked_rows(spark):
    data = [(1, 1, 1, 0.1), (1, 2, 0, 0.9), (2, 3, 1, 0.5)]
    found = ranker.ranked_hit_recall(spark.createDataFrame(data, "session int, aid int, t int, s double"), "t", "s", topk=1).first()
    assert (found.positives, found.hits, found.recall) == (2, 1, 0.5)


def test_session_filters(spark):
    """No item of a session is missed, and few others pass."""
    keys = spark.range(50).selectExpr("cast(id as int) as session").crossJoin(spark.range(100).selectExpr("cast(id * 37 as int) as aid")).withColumn("aid", (F.col("aid") + F.col("session") * 5000).cast("int"))
    found = features.session_filters(keys)
    assert found.where(F.size("filter") != features.FILTER_WORDS).count() == 0
    own = keys.join(found, "session")
    assert own.where(~features.may_hold(F.col("filter"), F.col("aid"))).count() == 0
    other = found.crossJoin(spark.range(2000).selectExpr("cast(1000000 + id as int) as aid"))
    assert 0.01 < other.where(features.may_hold(F.col("filter"), F.col("aid"))).count() / other.count() < 0.06


def test_filtered_signals_are_those_of_the_candidates(spark):
    rng = random.Random(4)
    rows = events(spark, *zip(*[(rng.randrange(30), rng.randrange(60), k, 0) for k in range(900)]))
    edges = spark.createDataFrame([(x, y, rng.random(), g) for x in range(60) for y in rng.sample(range(60), 12) for g in ("click_to_click", "click_to_cart_order")], "aid_x int, aid_y int, weight double, graph string")
    candidates = spark.createDataFrame([(s, a) for s in range(25) for a in rng.sample(range(60), 15)], "session int, aid int")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    every = features.graph_signal_features(rows, edges)
    for filtered in (False, True):
        assert rounded(features.graph_signals_for_candidates(rows, edges, candidates, filtered=filtered)) == rounded(every.join(candidates, ["session", "aid"], "left_semi").select(*every.columns))


def test_orders_and_lines_meet_once_for_item_features(spark, monkeypatch):
    """The join is made for one table, which the last day, the counts and the rates read; lines are not sorted for it."""
    from sessionrec.plans import queries

    joins, real = [], queries.orders

    def orders(*args):
        joins.append(real(*args))
        return joins[-1]

    monkeypatch.setattr(queries, "orders", orders)
    plan = queries.QUERIES["item_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
    join = joins[0]._jdf.queryExecution().executedPlan().toString()
    assert len(joins) == 1 and "ShuffledHashJoin" in join and "Sort" not in join
