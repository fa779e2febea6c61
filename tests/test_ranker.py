"""The ranker on small frames, and draws and thresholds against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sessionrec.functions import weights as W
from sessionrec.operators import ranker, sampling, selection
from sessionrec.operators.boosting import BoostedTrees, Settings
from sessionrec.sources import events as src


@pytest.fixture(scope="module")
def frame(spark):
    """Candidates whose target follows from candidate_score, with noise."""
    rng = random.Random(1)
    rows = []
    for session in range(60):
        for aid in range(25):
            score = rng.random()
            rows.append((session, aid, int(score + 0.2 * rng.random() > 0.95), *(score if f == "candidate_score" else rng.random() for f in ranker.BASE_FEATURES), None if rng.random() < 0.3 else rng.randrange(1000)))
    columns = ", ".join(f"{f} double" for f in ranker.BASE_FEATURES)
    rows = spark.createDataFrame(rows, f"session int, aid int, target_click int, {columns}, delta_t_nan long").withColumn("delta_t_filled", F.coalesce("delta_t_nan", F.lit(9_999_999)))
    return rows.cache()


@pytest.mark.parametrize("variant", ranker.DELTA_T)
def test_train_save_and_score(spark, frame, variant):
    training = ranker.ranker_training_frame(frame, "target_click", variant)
    held = ranker.ranker_frame(sampling.session_holdout(frame)[1], "target_click", variant)
    path = src.scratch_path(spark, f"ranker-test-{variant}")
    model, importance, figures = ranker.train_and_save(training, held, "target_click", path, variant, Settings(rounds=5, leaves=8, least=5))
    best = importance.orderBy(F.desc("gain")).first()
    assert (best.feature, importance.count()) == ("candidate_score", len(ranker.BASE_FEATURES) + 1)
    assert best.splits > 0 and importance.agg(F.sum("gain")).first()[0] == pytest.approx(1)
    f = figures.first()
    assert (f.train_rows, f.eval_sessions, f.eval_rows) == (54 * 25, 6, 150) and f.train_positive_rows + f.train_negative_rows == f.train_rows
    assert f.recall_at_20 == 1.0  # 25 candidates: the best 20 hold all the positives
    ranked = ranker.score_and_rank(model, held, "target_click", topk=3).collect()
    again = ranker.score_and_rank(BoostedTrees.load(spark, f"{path}/model"), held, "target_click", topk=3).collect()
    assert sorted(ranked) == sorted(again) and {(r.session, r["rank"]) for r in ranked} == {(s, k) for s in range(0, 60, 10) for k in (1, 2, 3)}
    assert spark.read.json(f"{path}/metrics").count() == 1


def test_most_rows(frame):
    assert ranker.ranker_training_frame(frame, "target_click", max_rows=0).count() == 54 * 25
    limited = ranker.ranker_training_frame(frame, "target_click", max_rows=500)
    counts = {r.session: r["count"] for r in limited.groupBy("session").count().collect()}
    assert set(counts.values()) == {25} and 200 < sum(counts.values()) < 800  # whole sessions


def test_draws(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (-5, None, "b")], "session int, aid int, kind string")
    found = [r[0] for r in rows.select(W.hash_draw(F.col("session"), F.col("aid"), F.col("kind"), seed=7)).collect()]
    assert found == [int(hashlib.md5(k).hexdigest()[:13], 16) % 1_000_000 for k in (b"1/2/a/7", b"-5/b/7")]


@pytest.mark.parametrize("sketch, few", [(2_000, 10_000), (2_000, 1), (3, 1)])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.8, 1.0])
def test_threshold_is_exact(spark, monkeypatch, sketch, few, q):
    """Ties and heavy tails; a bad sketch costs passes only."""
    monkeypatch.setattr(selection, "SKETCH", sketch)
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(3)
    weights = [rng.choice([0.0, rng.random(), 0.25, 0.5, rng.random() ** -20 if rng.random() < 0.1 else 0.5]) for _ in range(700)]
    rows = spark.createDataFrame([(0, w) for w in weights] + [(1, 9.0)], "target_order int, graph_w_cart_order_to_cart_order double").repartition(3).cache()
    found = sampling.graph_weight_threshold(rows, sampling.HardNegatives(quantile=q)).first()[0]
    positive = sorted(round(w, 9) for w in weights if w > 0)
    assert found == pytest.approx(positive[max(0, math.ceil(q * len(positive)) - 1)], rel=1e-15)
    assert sampling.graph_weight_threshold(rows.limit(0)).first()[0] == 0.0


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
@pytest.mark.parametrize("few", [10_000, 3])
def test_sampled_sessions_are_those_of_the_least_hashes(spark, monkeypatch, n, few):
    monkeypatch.setattr(selection, "FEW", few)
    rows = spark.range(1500).selectExpr("cast(id % 500 as int) as session", "cast(id as int) as aid", "id as ts", "cast(0 as tinyint) as type")
    sampled = src.sample_sessions(rows, n, seed=5)
    least = sorted(range(500), key=lambda s: (hashlib.md5(f"{s}/5".encode()).hexdigest(), s))[:n]
    assert {r.session: r["count"] for r in sampled.groupBy("session").count().collect()} == dict.fromkeys(least, 3)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Limit", "Exchange", "Join"))
