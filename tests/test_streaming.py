"""Streams over files give what the same batch gives."""

from datetime import datetime, timedelta

import pytest

from tidemark.sources import transcripts as R
from tidemark.streaming import ingest as I

T0 = datetime(2024, 1, 1)
ROWS = [("s1", "a", 0), ("s1", "a", 1), ("s2", "x", 1), ("s1", "b", 9), ("s2", "x", 10), ("s1", "b", 30)]


@pytest.fixture
def files(spark, tmp_path):
    rows = spark.createDataFrame([(s, c, T0 + timedelta(seconds=t)) for s, c, t in ROWS], "session string, capture string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def _run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_session_map(spark, files):
    rows, path = files
    batch = {tuple(r) for r in I.session_map(rows, "session", "capture", "ts").collect()}
    live = I.session_map(spark.readStream.schema(rows.schema).parquet(path), "session", "capture", "ts")
    assert {tuple(r) for r in _run(live, "smap").collect()} == batch == {("s1", "a", None), ("s1", "b", "a"), ("s2", "x", None)}


def test_first_seen(spark, files):
    rows, path = files
    live = I.first_seen(spark.readStream.schema(rows.schema).parquet(path), "session", "ts")
    assert {r.session for r in _run(live, "seen").collect()} == {r.session for r in I.first_seen(rows, "session", "ts").collect()}


def test_debounce(spark, files):
    rows, path = files
    batch = sorted((r.session, r.triggers, r.reason) for r in I.debounce(rows, "session", "ts", "capture", "2 seconds").collect())
    assert batch == [("s1", 1, "b"), ("s1", 1, "b"), ("s1", 2, "a"), ("s2", 1, "x"), ("s2", 1, "x")]
    live = I.debounce(spark.readStream.schema(rows.schema).parquet(path), "session", "ts", "capture", "2 seconds", late="1 second")
    got = {(r.session, r.triggers) for r in _run(live, "bursts").collect()}
    assert got <= {(s, n) for s, n, _ in batch} and ("s1", 2) in got  # the last bursts wait for the watermark


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type":"user"}\n{"type":\n')
    run = lambda: I.ingest(spark.readStream.text(str(tmp_path / "in")), R.parse_lines, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination(120)
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
