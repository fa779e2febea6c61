import random
from dataclasses import replace

import pytest
from conftest import events, rows
from conftest import rows as rows_of
from pyspark.sql import functions as F

from sessionrec.operators import graph as G
from sessionrec.operators import retrieval, windows

H = 3_600_000


@pytest.fixture(scope="module")
def toy(spark):
    return events(spark, [1, 1, 1, 1, 2, 2, 2], [10, 11, 12, 13, 10, 14, 15], [0, H, 2 * H, 3 * H, 0, H, 2 * H], [0, 0, 1, 2, 0, 1, 2])


def edges(df):
    return {(r.aid_x, r.aid_y): round(r.weight, 6) for r in df.collect()}


def test_rules(toy):
    cc, coco, cco = G.RULES
    assert dict(rows(G.item_frequency(toy))) == {10: 2, 11: 1, 12: 1, 13: 1, 14: 1, 15: 1}
    assert edges(G.rule_edges(toy, cc)) == {(10, 11): 0.606092}
    assert edges(G.rule_edges(toy, coco)) == {(12, 13): 8.946746, (14, 15): 8.946746}
    assert edges(G.rule_edges(toy, cco)) == {(10, 12): 4.072935, (10, 13): 7.986147, (11, 12): 5.877551, (11, 13): 11.52, (10, 14): 4.156056, (10, 15): 8.14587}


def test_penalty(spark):
    frequency = spark.createDataFrame([(4, 4), (9, 9)], "aid int, item_freq long")
    pairs = spark.createDataFrame([(4, 9), (4, 5)], "aid_x int, aid_y int")
    found = {r.aid_y: r.penalty for r in G.attach_degree_penalty(pairs, frequency, 0.5).collect()}
    assert found[9] == pytest.approx(1 / 6)
    assert found[5] == pytest.approx(1 / 2)


def test_equal_times_and_empty_graphs(spark):
    tied = events(spark, [1, 1], [1, 2], [5, 5], [0, 0])
    assert G.session_pairs(tied).count() == 0
    assert G.rule_graph_topk(tied).count() == 0
    assert G.covisitation_edges(tied.limit(0)).count() == 0


@pytest.mark.parametrize("rule", [*G.RULES, G.Rule("narrow", (0, 1), (1, 2), 7)])
def test_bands_find_the_pairs_of_whole_sessions(spark, rule):
    """Times on both sides of band edges, before zero too, and ties."""
    rng, step = random.Random(2), rule.max_dt_ms
    times = [k * step + d for k in (-2, -1, 0, 1, 2) for d in (-1, 0, 1, step // 2)]
    n = 400
    rows = events(spark, [rng.randrange(4) for _ in range(n)], [rng.randrange(9) for _ in range(n)], [rng.choice(times) for _ in range(n)], [rng.randrange(3) for _ in range(n)])
    found = rows_of(G.session_pairs_banded(rows, rule))
    assert found == rows_of(G.session_pairs_windowed(rows, rule)) and found
    whole = replace(rule, max_events=0)
    assert edges(G.rule_edges(rows, whole)) == pytest.approx(edges(G.rule_edges(rows, replace(rule, max_events=n))))


def test_a_session_of_a_bot_is_spread(spark):
    """100,000 events, one each second: a task has a small part of the session's pairs, and there are few beside them."""
    rule, n, parts = G.Rule("near", (0,), (0,), 20_000), 100_000, 32
    bot = spark.range(n).selectExpr("1 as session", "cast(id % 1000 as int) as aid", "id * 1000 as ts", "cast(0 as tinyint) as type")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        counts = [r["count"] for r in G.session_pairs_banded(bot, rule).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(counts) == sum(min(20, n - 1 - k) for k in range(n))
    assert len(counts) == parts and max(counts) < 2 * sum(counts) / parts


def test_buckets_lose_mass_only(spark, toy):
    exact = edges(G.rule_graph_topk(toy, [G.RULES[2]]))
    for edge, weight in edges(G.graph_topk_bucketed(toy, G.RULES[2])).items():
        assert weight <= exact[edge] + 1e-6


def test_retrieval(toy):
    popular = windows.popular_fallback_items(toy, 5)
    assert [(r.aid, r.score) for r in popular.orderBy("rank").collect()] == [(13, 6.0), (15, 6.0), (12, 3.0), (14, 3.0), (10, 2.0)]
    found = retrieval.recommend_from_graphs(toy, G.rule_graph_topk(toy), topk=5, min_candidates=5, popular=popular)
    assert dict(rows(found.groupBy("session").count())) == {1: 5, 2: 5}
    assert found.groupBy("session").agg(F.max("rank").alias("r")).where("r <> 5").count() == 0


def test_mixed(spark):
    mixed = events(spark, [1, 1, 1, 1, 2, 2], [101, 102, 103, 104, 103, 105], [1, 2, 3, 4, 1, 2], [0] * 6)
    wanted = spark.createDataFrame([(1,), (9,)], "session int")
    found = retrieval.recommend_mixed(mixed, wanted, topk=3)
    lists = {s: [r.aid for r in found.where(F.col("session") == s).orderBy("rank").collect()] for s in (1, 9)}
    assert lists[1] == [104, 103, 102]
    assert lists[9] == [103, 101, 102]


def test_mixed_lists_expand_in_many_tasks(spark):
    """Few bytes of sessions expand to many rows: all tasks take part, and no aggregate sorts."""
    many = spark.range(6000).selectExpr("cast(id % 300 as int) as session", "cast(id * 7 % 50 as int) as aid", "id as ts", "cast(0 as tinyint) as type")
    found = retrieval.recommend_mixed(many)
    assert found.count() == 300 * 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_seeds_are_expanded_once_for_counts_and_sums(toy):
    popular = windows.popular_fallback_items(toy, 5)
    found = retrieval.recommend_from_graphs(toy, G.rule_graph_topk(toy), topk=5, min_candidates=5, popular=popular)
    assert "seed_rank" not in found._jdf.queryExecution().optimizedPlan().toString()  # the scores are read from their table
