"""Graphs grown by batches against graphs of all events."""

import random

import pytest
from conftest import events

from sessionrec.operators import graph as G
from sessionrec.operators.incremental import GraphState

RULES = (
    G.Rule("near", (0, 1), (1, 2), 50_000, max_events=6, topk=4),
    G.Rule("wide", (0,), (0, 1, 2), 500_000, max_events=9, topk=4, weight=2.0),
    G.Rule("whole", (0, 1, 2), (2,), 90_000, max_events=0, topk=4),
)


def edges(df):
    return {(r.graph, r.aid_x, r.aid_y): (r["rank"], pytest.approx(r.weight, rel=1e-9)) for r in df.collect()}


def test_three_batches_make_the_graph_of_all_events(spark, tmp_path):
    """Sessions gain events that push others out of their newest ones, late events, ties and repeated events among them."""
    rng = random.Random(7)
    rows = [(rng.randrange(12), rng.randrange(15), rng.randrange(1_000) * 1_000, rng.randrange(3)) for _ in range(260)]
    rows += rows[:7]
    batches = [rows[:120], rows[120:125], rows[125:]]
    state, so_far = GraphState(spark, str(tmp_path / "graph"), RULES), []
    assert state.graph_topk().count() == 0
    for k, batch in enumerate(batches):
        old = [r for r in so_far if r[0] in {s for s, *_ in batch}]
        report = state.update(events(spark, *zip(*batch))).first()
        so_far += batch
        assert (report.new_events, report.sessions, report.old_events) == (len(batch), len({s for s, *_ in batch}), len(old))
        whole = events(spark, *zip(*so_far))
        assert edges(state.graph_topk()) == edges(G.rule_graph_topk(whole, RULES))
        assert report.all_pairs == state.sums().count() and state.versions() == list(range(1, k + 2))
    assert 0 < report.changed_pairs


def test_what_fails_is_done_again(spark, tmp_path, monkeypatch):
    first, second = ([1, 1], [1, 2], [0, 1000], [0, 2]), ([1, 2], [3, 3], [2000, 0], [2, 0])
    state = GraphState(spark, str(tmp_path / "graph"), RULES[:1])
    state.update(events(spark, *first))
    known = edges(state.graph_topk())
    with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
        m.setattr("sessionrec.operators.incremental.pair_sums", lambda *a: 1 / 0)
        state.update(events(spark, *second))
    assert state.versions() == [1] and edges(state.graph_topk()) == known
    state.update(events(spark, *second))
    both = events(spark, *[a + b for a, b in zip(first, second)])
    assert edges(state.graph_topk()) == edges(G.rule_graph_topk(both, RULES[:1]))


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    state = GraphState(spark, str(tmp_path / "graph"), RULES)
    rows = events(spark, [1, 1], [1, 2], [0, 1000], [0, 2])
    state.update(rows)
    report = state.update(rows.limit(0)).first()
    assert (report.new_events, report.old_events, report.changed_pairs) == (0, 0, 0)
    assert edges(state.graph_topk()) == edges(G.rule_graph_topk(rows, RULES))
