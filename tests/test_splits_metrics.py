import pytest
from conftest import events, rows
from pyspark.sql import functions as F

from sessionrec.operators import graph, metrics, retrieval, splits, submission
from sessionrec.schema import DAY_MS


@pytest.fixture(scope="module")
def toy(spark):
    return events(spark, [1, 1, 1, 2, 2, 2], [10, 11, 12, 10, 13, 12], [1, 2, 3, 1, 2, 3], [0, 0, 1, 0, 0, 2])


def test_tail_split_and_recall(toy):
    train, labels = splits.split_tail(toy)
    assert train.count() == 4
    assert rows(labels) == [(1, 1, [12]), (2, 2, [12])]
    edges = graph.covisitation_edges(train)
    assert {(r.aid_x, r.aid_y): round(r.weight, 6) for r in edges.collect()} == {(10, 11): 1.0, (10, 13): 1.0}
    found = retrieval.recommend_from_edges(train, edges, topk=3)
    assert {s: [r.aid for r in found.where(F.col("session") == s).orderBy("rank").collect()] for s in (1, 2)} == {1: [11, 10, 13], 2: [13, 10, 11]}
    assert [(r.type, r.total, r.hits, r.weighted_recall) for r in metrics.recall_at_k(labels, found, 3).orderBy("type").collect()] == [(1, 1, 0, 0.0), (2, 1, 0, 0.0)]


def test_tail_split_of_whole_times(spark):
    tied = events(spark, [1, 1, 1], [1, 2, 3], [1, 5, 5], [0, 0, 0])
    assert splits.split_tail(tied)[0].count() == 2
    assert splits.split_tail(tied, whole_times=True)[0].count() == 1


def test_time_split(spark):
    timed = events(spark, [1, 1, 2, 3], [1, 2, 3, 4], [0, 2 * DAY_MS, 2 * DAY_MS - 5, DAY_MS - 1], [0, 2, 1, 0])
    before, after = splits.split_time(timed)
    assert rows(before, "aid") == [(1,), (4,)] and rows(after, "aid") == [(2,), (3,)]
    assert rows(splits.label_targets(after)) == [(1, 2, 0, 0, 1), (2, 3, 0, 1, 0)]
    audit = splits.split_audit(before, after).first()
    assert (audit.both_sides, audit.strict_ok, audit.violations, audit.targets) == (1, 1, 0, 2)


def test_capped_recall(spark):
    labels = spark.createDataFrame([(1, "clicks", [104]), (2, "carts", [103]), (3, "orders", [104, 5]), (4, "orders", [])], "session int, type string, ground_truth array<int>")
    predictions = spark.createDataFrame([(1, "clicks", "104 1"), (2, "carts", " 103"), (3, "orders", "1 104"), (4, "orders", "")], "session int, type string, labels string")
    assert metrics.recall_at_k_capped(labels, predictions).first()[0] == pytest.approx((0.1 + 0.3 + 0.6 * 0.5))
    with pytest.raises(ValueError):
        metrics.recall_at_k_capped(labels.drop("type"), predictions)


def test_label_strings_and_submission(spark):
    texts = spark.createDataFrame([("",), ("  ",), (" 1  2\t3 ",), (None,)], "t string")
    assert [r[0] for r in texts.select(metrics.parse_labels(F.col("t"))).collect()] == [[], [], [1, 2, 3], []]
    candidates = spark.createDataFrame([(7, 5, 2), (7, 9, 1)], "session int, aid int, rank int")
    assert rows(submission.format_submission(candidates)) == [("7_carts", "9 5"), ("7_clicks", "9 5"), ("7_orders", "9 5")]
