"""Jobs that write by buckets: parts, stats, resuming."""

import random

import pytest
from conftest import events, rows
from pyspark.sql import functions as F

from sessionrec.operators import features as feat
from sessionrec.operators import parts as P
from sessionrec.operators import sampling as S


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    seen = events(spark, *zip(*[(rng.randrange(24), rng.randrange(30), k * 1000, rng.randrange(3)) for k in range(400)]))
    edges = spark.createDataFrame([(x, y, rng.random(), g) for x in range(30) for y in rng.sample(range(30), 6) for g in ("click_to_click", "cart_order_to_cart_order")], "aid_x int, aid_y int, weight double, graph string")
    pool = spark.createDataFrame([(s, a, rng.random(), k + 1) for s in range(24) for k, a in enumerate(rng.sample(range(30), 12))], "session int, aid int, score double, rank int")
    return pool, seen, edges


def test_feature_parts_are_those_of_one_job(spark, tables, tmp_path):
    path = str(tmp_path / "features")
    whole = feat.interaction_features(*tables)
    stats = P.write_interaction_features(*tables, path, 4, only=(2,))
    assert rows(stats) == [(2, 72)] and P.written_buckets(spark, f"{path}/parts") == [2]
    stamp = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "features/parts/bucket=2").glob("*.parquet")}
    stats = P.write_interaction_features(*tables, path, 4, resume=True)
    assert rows(stats) == [(k, 72) for k in range(4)]
    assert stamp == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "features/parts/bucket=2").glob("*.parquet")}  # it was not made again
    rounded = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*whole.columns).collect())
    assert rounded(spark.read.parquet(f"{path}/parts")) == rounded(whole)
    # A bucket that was spoilt is made anew; the others stay.
    spark.read.parquet(f"{path}/parts").where("bucket = 1").limit(3).withColumn("aid", F.lit(-1)).drop("bucket").write.mode("overwrite").parquet(f"{path}/spoilt")
    spark.read.parquet(f"{path}/spoilt").write.mode("overwrite").parquet(f"{path}/parts/bucket=1")
    P.write_interaction_features(*tables, path, 4, only=(1,))
    assert rounded(spark.read.parquet(f"{path}/parts")) == rounded(whole)
    assert rows(P.write_interaction_features(*tables, path, 4, resume=True)) == [(k, 72) for k in range(4)]


def test_hard_negative_parts(spark, tables, tmp_path):
    path, rng = str(tmp_path / "negatives"), random.Random(6)
    wanted = spark.createDataFrame([(s, rng.randrange(30), 1, 0, 1) for s in range(20)], "session int, aid int, target_click int, target_cart int, target_order int")
    labelled = S.label_candidates(feat.interaction_features(*tables), wanted).cache()
    config = S.HardNegatives(target="target_click", hard_click=2, hard_graph=3, random=1)
    items = feat.item_features(tables[1])
    stats = {r.part: r for r in P.write_hard_negatives(labelled, path, config, 3, items).collect()}
    assert set(stats) == {"0", "1", "2", "__TOTAL__"}
    sample = S.sample_hard_negatives(labelled, config, items)
    written = spark.read.parquet(f"{path}/parts")
    assert rows(written, "session", "aid", "negative_bucket", "total_interactions") == rows(sample, "session", "aid", "negative_bucket", "total_interactions")
    for part, r in stats.items():
        own = sample if part == "__TOTAL__" else sample.where(F.col("session") % 3 == int(part))
        counts = {k: own.where(F.col("negative_bucket") == k).count() for k in P.KINDS}
        assert [r[f"{k}_rows"] for k in P.KINDS] == list(counts.values()) and r.rows == sum(counts.values()) == r.negative_rows + r.positive_rows
        assert r.neg_pos_ratio == (pytest.approx(r.negative_rows / r.positive_rows) if r.positive_rows else None)
        assert r.graph_threshold == S.weight_threshold(labelled, config)
    empty = P.write_hard_negatives(labelled.limit(0), str(tmp_path / "none"), config, 3).collect()
    assert [(r.part, r.rows, r.neg_pos_ratio) for r in empty] in ([], [("__TOTAL__", 0, None)])
