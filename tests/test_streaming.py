"""Session documents that arrive in several batches."""

import json
import random

from conftest import events, rows
from pyspark.sql import functions as F

from sessionrec.sources import events as src
from sessionrec.streaming import ingest, visits


def test_popularity_over_batches(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    hour = 3_600_000
    batches = [
        [{"session": 1, "events": [{"aid": 5, "ts": 10, "type": "clicks"}, {"aid": 5, "ts": 20, "type": "carts"}, {"aid": 6, "ts": hour + 1, "type": "clicks"}]}],
        [{"session": 2, "events": [{"aid": 5, "ts": 30, "type": "clicks"}]}],  # late, within the watermark
        [{"session": 3, "events": [{"aid": 7, "ts": 5 * hour, "type": "orders"}]}],
        [{"session": 4, "events": [{"aid": 5, "ts": 40, "type": "clicks"}]}],  # too late: its span is closed
        [{"session": 5, "events": []}],
    ]
    for k, batch in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
        counts = ingest.recent_popularity(ingest.stream_session_json(spark, str(folder)), "1 hour", "2 hours")
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = {(r.at, r.aid): r.events for r in spark.read.parquet(out).select((F.unix_millis("start") / hour).cast("int").alias("at"), "aid", "events").collect()}
    assert found == {(0, 5): 3, (1, 6): 1}


def test_scratch_is_cleared(spark):
    path = src.scratch_path(spark, "x.parquet")
    spark.range(3).write.parquet(path)
    src.clear_scratch(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def plain_visits(events, gap):
    out = []
    for session in sorted({s for s, *_ in events}):
        visit = []
        for e in [*sorted((e for e in events if e[0] == session), key=lambda e: e[2]), None]:
            if visit and (e is None or e[2] - visit[-1][2] > gap):
                times, types = [v[2] for v in visit], [v[3] for v in visit]
                window = len(visit) >= 50 and not {1, 2} & set(types)
                out.append((session, len(visit), len({v[1] for v in visit}), times[0], times[-1], types.count(1), types.count(2), times[-1] - times[0], int(window)))
                visit = []
            if e:
                visit.append(e)
    return sorted(out)


COLUMNS = ("session", "visit_length", "unique_items", "first_ts", "last_ts", "cart_count", "order_count", "duration", "is_window_shopping")


def test_visits_of_out_of_order_batches_are_those_of_the_table(spark, tmp_path):
    """Batches open visits, lengthen them at both ends and join two into one; pauses of exactly the gap stay inside."""
    rng, minute = random.Random(3), 60_000
    rows_in = [(rng.randrange(5), rng.randrange(9), rng.randrange(3000) * minute, rng.choice([0, 0, 0, 1, 2])) for _ in range(300)]
    rows_in += [(7, k, k * minute, 0) for k in range(60)] + [(8, 1, 0, 0), (8, 1, 30 * minute, 0), (8, 2, 61 * minute, 1)] + rows_in[:5]
    want = plain_visits(rows_in, 30 * minute)
    assert rows(visits.visit_features(events(spark, *zip(*rows_in)), "30 minutes"), *COLUMNS) == want
    assert {(v[0], v[1]) for v in want} >= {(8, 2), (8, 1), (7, 60)}
    rng.shuffle(rows_in)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(4):
        events(spark, *zip(*rows_in[k::4])).coalesce(1).write.parquet(f"{source}/{k}.parquet")
        visits.write_visits(spark, f"{source}/*.parquet", target, state, "30 minutes", "100 hours")
    assert spark.read.parquet(target).count() == 0  # all are within the delay
    events(spark, [99], [1], [10_000 * minute], [0]).write.parquet(f"{source}/9.parquet")
    visits.write_visits(spark, f"{source}/*.parquet", target, state, "30 minutes", "100 hours")
    assert rows(spark.read.parquet(target), *COLUMNS) == want
    # What comes after the watermark is dropped: no visit is given twice.
    events(spark, *zip(*rows_in[:20])).write.parquet(f"{source}/late.parquet")
    events(spark, [99], [1], [30_000 * minute], [0]).write.parquet(f"{source}/z.parquet")
    visits.write_visits(spark, f"{source}/*.parquet", target, state, "30 minutes", "100 hours")
    assert rows(spark.read.parquet(target).where("session <> 99"), *COLUMNS) == want
