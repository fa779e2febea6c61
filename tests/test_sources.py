import pytest
from conftest import events, rows
from pyspark.errors import PySparkException

from sessionrec.sources import events as src
from sessionrec.streaming import ingest

LINES = """{"session": 1, "events": [{"aid": 5, "ts": 10, "type": "clicks"}, {"aid": 6, "ts": 20, "type": "orders"}]}

{"session": 2, "events": []}
{"session": 3}
{"session": 4, "events": [{"aid": 7, "ts": 30, "type": "carts"}]}
"""
FLAT = [(1, 5, 10, 0), (1, 6, 20, 2), (4, 7, 30, 1)]


def test_json(spark, tmp_path):
    path = tmp_path / "sessions.jsonl"
    path.write_text(LINES)
    assert rows(src.read_events(spark, str(path))) == FLAT
    target = str(tmp_path / "flat.parquet")
    src.compact_to_parquet(spark, str(path), target)
    assert rows(src.read_events(spark, target)) == FLAT
    path.write_text('{"session": 1, "events": [{"aid": 5, "ts": 10, "type": "views"}]}')
    with pytest.raises(PySparkException):
        src.read_session_json(spark, str(path)).collect()
    assert src.read_session_json(spark, str(path), strict=False).first().type is None


def test_round_trips(spark, tmp_path):
    df = events(spark, *zip(*FLAT))
    for name in ("a.csv", "a.parquet"):
        src.write_events(df, str(tmp_path / name))
        assert rows(src.read_events(spark, str(tmp_path / name))) == FLAT
    for call in (src.read_events, lambda s, p: src.write_events(df, p)):
        with pytest.raises(ValueError):
            call(spark, str(tmp_path / "a.xml"))


def test_buckets_are_rewritten_alone(spark, tmp_path):
    df = events(spark, [1, 2, 3, 4], [1, 2, 3, 4], [1] * 4, [0] * 4)
    path = str(tmp_path / "b")
    src.write_session_buckets(df, path, 2)
    src.write_session_buckets(df.where("session <> 3"), path, 2, only=[1])
    assert rows(spark.read.parquet(path), "session", "bucket") == [(1, 1), (2, 0), (4, 0)]


def test_samples_keep_whole_sessions(spark):
    df = events(spark, [k // 3 for k in range(90)], list(range(90)), [1] * 90, [0] * 90)
    found = src.sample_sessions(df, 7)
    assert [r[1] for r in rows(found.groupBy("session").count())] == [3] * 7
    assert rows(found) == rows(src.sample_sessions(df, 7))
    assert rows(src.limit_sessions(df, 2), "session") == [(0,)] * 3 + [(1,)] * 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(LINES)
    stream = ingest.stream_session_json(spark, str(tmp_path / "in"))
    job = stream.writeStream.format("memory").queryName("flat").trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert rows(spark.table("flat")) == FLAT


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
