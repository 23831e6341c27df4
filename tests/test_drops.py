"""Drop accounting over a stream: told when idle, once, also across a restart."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import drops as D


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, D.ROCKSDB)
    yield spark
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def wait(done, query, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not done():
        if query.exception():
            raise query.exception()
        time.sleep(0.3)
    assert done()


def test_counts_come_out_once_when_idle_and_survive_a_restart(rocks, tmp_path):
    spark = rocks
    at = {k: str(tmp_path / k) for k in ("in", "out", "check")}
    schema = "surface string, dropped long"
    drop = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at["in"])
    drop([("hook", 2), ("otel", 5), ("hook", 1)], 0)

    def start(quiet):
        counts = D.drop_counts(spark.readStream.schema(schema).parquet(at["in"]), "surface", quiet)
        return counts.writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["check"]).trigger(processingTime="300 milliseconds").start()

    def told():
        try:
            return sorted((r.surface, r.dropped) for r in spark.read.schema("surface string, dropped long, batches long").parquet(at["out"]).collect())
        except Exception:
            return []

    q = start(1500)
    wait(lambda: len(told()) == 2, q)
    assert told() == [("hook", 3), ("otel", 5)]
    drop([("hook", 7)], 1)
    wait(lambda: any(p["numInputRows"] for p in q.recentProgress[-3:]) or len(told()) == 3, q)
    q.stop()  # before or behind its quiet time
    q = start(1500)
    wait(lambda: len(told()) == 3, q)
    time.sleep(3)  # nothing is told again
    q.stop()
    assert told() == [("hook", 3), ("hook", 7), ("otel", 5)]


def test_batch_and_shedding(spark):
    rows = spark.createDataFrame([("a", "otel.metric.x")] * 8 + [("a", "hook")] * 5 + [("b", "otel.metric.x")] * 3 + [(None, "otel.trace")] * 12 + [("c", None)] * 20, "surface string, kind string")
    kept, lost = D.shed(rows, "surface", "kind", most=10)
    assert sorted(map(tuple, lost.collect()), key=str) == [("a", 8), (None, 12)]
    assert {(r.surface, r.n) for r in kept.groupBy("surface").agg(F.count("*").alias("n")).collect()} == {("a", 5), ("b", 3), ("c", 20)}
    assert {(r.surface, r.dropped) for r in D.drop_counts(lost, "surface").collect()} == {("a", 8), (None, 12)}
