"""The heaviest items against a count of all items."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionrec.operators import heavy


@pytest.fixture(scope="module")
def seen(spark):
    """Few heavy items among many light ones, which lie apart in some parts; ties."""
    rng, rows = random.Random(2), []
    for k in range(12_000):
        aid = rng.randrange(8) if rng.random() < 0.4 else rng.randrange(100, 3_000)
        rows.append((aid, rng.choice([1, 3, 6])))
    rows += [(50, 1)] * 400 + [(51, 1)] * 400 + [(None, 6)] * 30
    return rows, spark.createDataFrame(rows, "aid int, w int").repartition(6)


def plain(rows, k):
    total = Counter()
    for aid, w in rows:
        total[aid] += w if aid is not None else 0
    return [(a, float(s), r) for r, (a, s) in enumerate(sorted(((a, s) for a, s in total.items() if a is not None), key=lambda x: (-x[1], x[0]))[:k], 1)]


@pytest.mark.parametrize("k", [1, 9, 10, 12, 500, 5_000])
@pytest.mark.parametrize("counters", [20, 300, 8_192])
def test_exact_whatever_the_summaries(seen, k, counters):
    rows, df = seen
    assert [tuple(r) for r in heavy.heavy_items(df, F.col("w"), k, counters).orderBy("rank").collect()] == plain(rows, k)


def test_only_possible_items_are_counted(seen, monkeypatch):
    rows, df = seen
    counted = []
    real = heavy.F.broadcast
    monkeypatch.setattr(heavy.F, "broadcast", lambda x: counted.append(x.count()) or real(x))
    assert [r.aid for r in heavy.heavy_items(df, F.col("w"), 8, 300).orderBy("rank").collect()] == [a for a, _, _ in plain(rows, 8)]
    assert counted and counted[0] < 30  # of some 2,900
    counted.clear()
    heavy.heavy_items(df, F.col("w"), 500, 20).collect()
    assert not counted  # the bound can't decide: all are


def test_no_events(seen):
    assert heavy.heavy_items(seen[1].limit(0), F.col("w"), 5).count() == 0
