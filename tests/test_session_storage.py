"""Tables by session meet without a shuffle; buckets are written by many tasks."""

import re

import pytest
from conftest import events, rows

from sessionrec.operators import features as feat
from sessionrec.operators import graph as G
from sessionrec.operators import sampling as S
from sessionrec.operators import splits
from sessionrec.plans import queries
from sessionrec.sources import events as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    train, label = queries.sides(spark, SF)
    edges = queries.edges_of(train)
    yield {"events": train, "label": label, "edges": edges, "pool": queries.pool_by(train, edges)}
    for k, v in held.items():
        spark.conf.set(k, v)


def shuffled(df) -> list[str]:
    """What the plan shuffles by, as far as sessions are concerned."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "session" in x]


STAGES = {
    "events_for_candidates": lambda t: feat.events_for_candidates(t["events"], t["pool"]),
    "label_candidates": lambda t: S.label_candidates(t["pool"], splits.label_targets(t["label"])),
    "local_item_stats": lambda t: feat.local_item_stats(t["events"]),
    "session_last_ts": lambda t: feat.session_last_ts(t["events"]),
}


@pytest.mark.parametrize("name", STAGES)
def test_no_shuffle_by_session(stored, name):
    assert shuffled(STAGES[name](stored)) == []


def test_features_shuffle_expanded_seeds_only(stored):
    """Seeds go to the graph by item; what comes back is the one thing that is shuffled to the sessions' tables."""
    found = shuffled(feat.interaction_features(stored["pool"], stored["events"], stored["edges"]))
    assert len(found) <= 2, found
    assert shuffled(feat.interaction_features(src.staged(stored["pool"], "plain"), src.staged(stored["events"], "plain"), stored["edges"])) > found


def test_stored_tables_hold_all_rows(spark):
    df = events(spark, [5, 1, 3, 1, 2, 4], [1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1], [0, 1, 2, 0, 1, 2])
    whole = src.staged_by_session(df, "t", buckets=3)
    assert rows(whole) == rows(df)
    split = src.staged_by_session(splits.with_side(df, cutoff=4), "t", buckets=3, side="side")
    assert rows(split.where("side = 0").select(*df.columns)) == rows(df.where("ts < 4"))
    assert rows(src.staged_by_session(df.limit(0), "t")) == []


def test_buckets_are_written_by_many_tasks(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(id % 400 as int) as session", "cast(id as int) as aid", "id as ts", "cast(0 as tinyint) as type")
    src.write_session_buckets(df, str(tmp_path / "b"), 2, parts=5)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert rows(back.select(*df.columns)) == rows(df)
    files = {f.parent.name: len(list(f.parent.glob("*.parquet"))) for f in (tmp_path / "b").rglob("*.parquet")}
    assert set(files) == {"bucket=0", "bucket=1"} and min(files.values()) >= 3
    per_file = back.selectExpr("session", "input_file_name() as f").distinct()
    assert per_file.count() == 400  # a session is in one file


def test_scratch_tables_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(src, "_made", {})
    monkeypatch.setattr(src, "_tables", {})
    src.staged_by_session(spark.range(3).selectExpr("id as session"), "gone")
    (name,) = src._tables[spark.sparkContext.applicationId]
    src.clear_scratch(spark)
    assert not spark.catalog.tableExists(name)


def test_rules_without_limit_take_whole_sessions(spark):
    df = events(spark, [1] * 6, [1, 2, 3, 4, 5, 6], [k * 1000 for k in range(6)], [0] * 6)
    near = G.Rule("near", (0,), (0,), 1000, max_events=0)
    assert {(r.aid_x, r.aid_y) for r in G.rule_graph_topk(df, [near]).collect()} == {(k, k + 1) for k in range(1, 6)}
