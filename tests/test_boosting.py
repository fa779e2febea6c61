"""Boosted trees against a plain version that sorts rows and splits node by node."""

import math
import pickle
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionrec.operators import boosting
from sessionrec.operators.boosting import BoostedTrees, Settings


def plain_trees(x, y, keys, edges, s):
    """Trees by trying every edge of every feature on the rows themselves; each leaf's best split is found anew."""
    base = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)
    for turn in range(s.rounds):
        seen = sorted(random.Random(f"{s.seed}/{turn}").sample(range(x.shape[1]), max(1, round(s.feature_share * x.shape[1]))))
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        drawn = boosting.sampled(keys, s.seed, turn, s.row_share)

        def best(rows):
            found = (0.0, None)
            inside = rows[drawn[rows]]
            score = lambda at: g[at].sum() ** 2 / h[at].sum()
            for missing_left in (False, True):
                for f in seen:
                    v = x[inside, f]
                    for e in edges[f]:
                        to_left = np.where(np.isnan(v), missing_left, v <= e)
                        a, b = inside[to_left], inside[~to_left]
                        if min(len(a), len(b)) >= s.least and min(h[a].sum(), h[b].sum()) >= s.least_curvature:
                            gain = score(a) + score(b) - score(inside)
                            if gain > found[0] + 1e-9:
                                found = gain, (f, e, missing_left)
                    if not missing_left and np.isnan(v).any():  # all known values against the missing ones
                        a, b = inside[~np.isnan(v)], inside[np.isnan(v)]
                        if min(len(a), len(b)) >= s.least and min(h[a].sum(), h[b].sum()) >= s.least_curvature:
                            gain = score(a) + score(b) - score(inside)
                            if gain > found[0] + 1e-9:
                                found = gain, (f, math.inf, False)
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda k: leaves[k][0][0])
            (gain, split), rows = leaves[k]
            if gain <= 0:
                break
            f, e, missing_left = split
            v = x[rows, f]
            to_left = np.where(np.isnan(v), missing_left, v <= e)
            leaves[k : k + 1] = [(best(r), r) for r in (rows[to_left], rows[~to_left])]
        for _, rows in leaves:
            at = rows[drawn[rows]]
            margin[rows] -= s.step * g[at].sum() / h[at].sum()
    return margin


def rows_of(n, seed, missing):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = rng.random(), rng.randrange(6), rng.gauss(0, 1)
        gone = missing and rng.random() < 0.3
        y = int(rng.random() < 1 / (1 + math.exp(-(3 * a - 1.5 + (b == 2) + (1.5 if gone else math.sin(2 * c))))))
        out.append((k // 20, k % 20, y, a, float(b), None if gone else c))
    return out


COLUMNS = "session int, aid int, y int, a double, b double, c double"


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("blocks", [200, 50_000])
def test_as_the_plain_version(spark, monkeypatch, missing, blocks):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", blocks)
    s = Settings(rounds=4, leaves=9, least=15, step=0.3)
    rows = rows_of(800, 1, missing)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    model = boosting.train_boosted_trees(frame, "y", "abc", ("session", "aid"), s)
    held = frame.select("session", "aid", "a", "b", "c", "y", F.xxhash64("session", "aid").alias("key")).orderBy("session", "aid").toPandas()
    x = held[["a", "b", "c"]].to_numpy(dtype=float)
    want = plain_trees(x, held.y.to_numpy(dtype=float), held.key.to_numpy().view(np.uint64), boosting.bin_edges(frame, "abc"), s)
    assert model.margins(x) == pytest.approx(want, abs=1e-9)
    assert all(sum(f < 0 for f in t.feature) <= 9 for t in model.trees) and len(model.trees) == 4


@pytest.mark.parametrize("missing", [False, True])
def test_passes_as_the_plain_version(spark, monkeypatch, missing):
    """Frames beyond TASK_ROWS, whose passes are jobs."""
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    test_as_the_plain_version(spark, monkeypatch, missing, 200)


def test_rounds_of_a_task_need_no_jobs(spark, monkeypatch):
    """A frame of several blocks: jobs don't grow with rounds and levels, and rounds that go on in a second job give the same trees."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    frame = spark.createDataFrame(rows_of(800, 1, True), COLUMNS).repartition(3)
    s, found = Settings(rounds=12, leaves=9, least=15), {}
    for job in (50, 5):
        monkeypatch.setattr(boosting, "ROUNDS_OF_TASK", job)
        group = f"rounds-{job}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            found[job] = boosting.train_boosted_trees(frame, "y", "abc", ("session", "aid"), s)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 12
    x = frame.select("a", "b", "c").toPandas().to_numpy(dtype=float)
    assert len(found[5].trees) == 12 and found[50].margins(x) == pytest.approx(found[5].margins(x), abs=1e-9)


def counted(monkeypatch, rows, settings, base=-0.5):
    """What the rounds of a task give, and how many values their histograms added up."""
    edges = [np.linspace(0, 1, 99), np.arange(5.0), np.arange(3.0)]
    key, target, *x = (np.array(c) for c in zip(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(target, pa.float64()), *[pa.array(c, pa.float64()) for c in x]], names=["key", "target", *"abc"])
    added, real = [], np.bincount
    with monkeypatch.context() as m:
        m.setattr(np, "bincount", lambda codes, *args, **kwargs: added.append(len(codes)) or real(codes, *args, **kwargs))
        found = list(boosting.rounds_of_task(edges, settings, base, [], range(settings.rounds))(boosting.binned(edges)(iter([batch]))))
    return [pickle.loads(b.column(1)[0].as_py())[0] for b in found], sum(added)


def rows_of_task(n, copies=1):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.1), rng.random(), float(rng.randrange(6)), float(rng.randrange(4))) for _ in range(n)]
    return [(k * n + i, *row) for k in range(copies) for i, row in enumerate(rows)]


def test_rows_of_equal_bins_are_added_up_once(monkeypatch):
    """Five copies of each row give the trees of one, with five times the rows, for little more work."""
    s = Settings(rounds=3, leaves=9, least=20, row_share=1.0)
    once, work = counted(monkeypatch, rows_of_task(3_000), s)
    many, more = counted(monkeypatch, rows_of_task(3_000, 5), replace(s, least=100, least_curvature=5 * s.least_curvature))
    assert [(t.feature, t.threshold, [5 * n for n in t.rows]) for t in once] == [(t.feature, t.threshold, t.rows) for t in many]
    assert more < 2 * work


@pytest.mark.parametrize("flat", [0, 200, 10_000])
def test_histograms_of_a_task_are_those_of_the_rows(monkeypatch, flat):
    """Of small nodes and large ones, with shared columns and without, against sums over the blocks of passes."""
    monkeypatch.setattr(boosting, "FLAT_ROWS", flat)
    rng, s = np.random.default_rng(6), Settings(leaves=9)
    bins = np.stack([rng.integers(0, high, 2_000) for high in (255, 6, 4, 3)], axis=1).astype(np.uint8)
    bins[:300, 0] = bins[200:500, 2] = boosting.MISSING
    bins[1_500:] = bins[:500]
    key, y = np.arange(2_000, dtype=np.int64), (rng.random(2_000) < 0.2).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(y), pa.array([b.tobytes() for b in bins], pa.binary())], names=["key", "target", "bins"])
    block = boosting.Block(np.ascontiguousarray(bins.T), y, key.view(np.uint64), np.full(2_000, -1.0))
    step = boosting.Turn(boosting.distinct([batch], 4, -1.0), s, 3)
    splits = [(0, 0, 20, False, 1, 2), (2, 2, 1, True, 3, 4), (4, 1, 3, False, 5, 6), (3, 0, 200, True, 7, 8)]
    wanted = [1, 3, 6, 8]
    for k in range(-1, len(splits)):
        want = next(boosting.histograms(splits[: k + 1], wanted[k : k + 1] if k >= 0 else [0], s, 3)(iter([block])))
        found = np.stack(step.histograms(splits[k : k + 1] if k >= 0 else [], wanted[k : k + 1] if k >= 0 else [0]))
        assert (found[:, 0] == want[:, 0]).all() and found == pytest.approx(want, abs=1e-9)


def test_equal_splits_do_not_depend_on_rounding():
    """The second feature parts the rows as the first does; its sums are a little larger in the last bits only."""
    sums = np.zeros((3, 2, boosting.BINS + 1))
    sums[:, :, 0], sums[:, :, 1] = np.array([[200, -30, 20]]).T, np.array([[300, 45.5, 30]]).T
    for eps in (-1e-13, 0, 1e-13):
        sums[1, 1, 0] = -30 * (1 + eps)
        node = boosting.best_split(sums, [0, 1], Settings())
        assert (node.feature, node.bin, node.missing_left) == (0, 0, False) and node.gain == pytest.approx(30**2 / 20 + 45.5**2 / 30 - 15.5**2 / 50)


def test_missing_values_learn_their_way(spark):
    """The target is 1 where c is missing: a fill in the middle of the known values could not tell."""
    rows = [(k, 0, int(k % 3 == 0), 0.0, 0.0, None if k % 3 == 0 else float(k % 7)) for k in range(600)]
    frame = spark.createDataFrame(rows, COLUMNS)
    model = boosting.train_boosted_trees(frame, "y", "abc", ("session", "aid"), Settings(rounds=30, leaves=4, least=20, step=0.3, feature_share=1.0))
    found = frame.select("y", model.score().alias("p")).groupBy("y").agg(F.min("p"), F.max("p")).collect()
    assert {r.y: r[1] > 0.95 if r.y else r[2] < 0.05 for r in found} == {0: True, 1: True}


def test_saved_models_score_alike(spark):
    frame = spark.createDataFrame(rows_of(600, 2, True), COLUMNS)
    model = boosting.train_boosted_trees(frame, "y", "abc", ("session", "aid"), Settings(rounds=12, leaves=5, least=10))
    path = boosting.staged(spark.range(1), "x").inputFiles()[0].rsplit("/", 1)[0] + "-model"
    model.save(spark, path)
    assert BoostedTrees.load(spark, path) == model


@pytest.mark.parametrize("values", [[], [0, 0], [1, 1]])
def test_nothing_to_learn(spark, values):
    frame = spark.createDataFrame([(k, 0, y, 0.5, 1.0, None) for k, y in enumerate(values)], COLUMNS)
    model = boosting.train_boosted_trees(frame, "y", "abc", ("session", "aid"))
    assert model.trees == [] and frame.select(model.score().alias("p")).where("p <> 0.5").count() == 0
