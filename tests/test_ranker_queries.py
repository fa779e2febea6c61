import threading

import pytest

from sessionrec.operators import ranker
from sessionrec.operators.boosting import Settings
from sessionrec.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture
def asked(monkeypatch):
    """Settings that queries ask for; two rounds are trained."""
    found, real = [], ranker.train_boosted_trees

    def train(frame, target, features, keys, settings):
        found.append(settings)
        return real(frame, target, features, keys, Settings(rounds=2))

    monkeypatch.setattr(ranker, "train_boosted_trees", train)
    monkeypatch.setattr(queries, "_TRAINED", {})
    return found


def test_both_queries_share_models_trained_in_full(spark, asked):
    found = queries.QUERIES["train_click_ranker"](spark, SF).collect()
    assert asked == [Settings(rounds=250, leaves=63, step=0.05, least=100, row_share=0.9, feature_share=0.9)] * 2
    assert {v: {r.feature for r in found if r.variant == v} for v in ("nan", "filled")} == {v: set(ranker.feature_names(v)) for v in ("nan", "filled")}
    ranked = queries.QUERIES["score_and_rank"](spark, SF).collect()
    assert len(asked) == 2  # the saved models were read
    kept = {v: {(r.session, r["rank"]) for r in ranked if r.variant == v} for v in ("nan", "filled")}
    assert kept["nan"] and kept["nan"] == kept["filled"] and len(ranked) == 2 * len(kept["nan"])


@pytest.mark.parametrize("name", ["downsample_negatives", "sample_hard_negatives", "train_click_ranker", "score_and_rank"])
def test_samples_and_rankers_use_the_full_pool(spark, asked, monkeypatch, name):
    sizes, real = [], queries.ret.recommend_from_graphs

    def recommend(events, edges, topk, min_candidates, popular):
        sizes.append((topk, min_candidates))
        return real(events, edges, topk=topk, min_candidates=min_candidates, popular=popular)

    monkeypatch.setattr(queries.ret, "recommend_from_graphs", recommend)
    queries.QUERIES[name](spark, SF)
    assert sizes == [(100, 50)]


def test_variants_are_trained_at_once(spark, monkeypatch):
    """Each waits for the other."""
    both = threading.Barrier(2, timeout=30)
    monkeypatch.setattr(queries, "_TRAINED", {})
    monkeypatch.setattr(queries.R, "train_and_save", lambda *args: both.wait())
    assert set(queries._models(spark, SF)[0]) == {"nan", "filled"} and not both.broken
