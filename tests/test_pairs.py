"""Pairs that agree on any key, and links by the clock: against all pairs, by each way of joining."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, linking
from tidemark.operators.lineage import outcomes_about


@pytest.mark.parametrize("limit", [400_000, 0])
def test_pairs_of_any_key_are_told_once(spark, monkeypatch, limit):
    """Ids of several rows, repeated rows and null keys; with limit 0 both sides are shuffled."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    key = lambda: rng.choice([None, *range(6)])
    left, right = [(rng.randrange(25), key(), key()) for _ in range(40)], [(rng.randrange(18), key(), key()) for _ in range(30)]
    want = {(a, b) for a, x, y in left for b, u, v in right if (x is not None and x == u) or (y is not None and y == v)}
    df = joins.any_key_match(spark.createDataFrame(left, "a long, x long, y long"), spark.createDataFrame(right, "b long, u long, v long"), [("x", "u"), ("y", "v")], ["a"], ["b"])
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want)
    assert set(got) == want


@pytest.mark.parametrize("limit", [400_000, 0])
def test_pairs_of_large_keys_are_met_in_blocks(spark, monkeypatch, limit):
    """Keys of more rows than a block on either side; with limit 0 what tells their blocks is joined by a shuffle, too, and nothing is broadcast."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(joins, "LEFT_BLOCK", 5, raising=False)
    monkeypatch.setattr(joins, "RIGHT_BLOCK", 3, raising=False)
    left, right = [(i, i % 7 or None, i % 2) for i in range(60)], [(i, i % 9, i % 3) for i in range(50)] + [(3, 1, 1)]
    want = {(a, b) for a, x, y in left for b, u, v in right if (x is not None and x == u) or y == v}
    df = joins.any_key_match(spark.createDataFrame(left, "a long, x long, y long"), spark.createDataFrame(right, "b long, u long, v long"), [("x", "u"), ("y", "v")], ["a"], ["b"])
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_pairs_broadcast_no_side(spark):
    """A right side of more rows than may be broadcast looks small to the planner, also told to many parts."""
    left = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 500).alias("x"))
    right = spark.range(joins.BROADCAST_ROWS + 1).select(F.col("id").alias("b"), (F.col("id") % 400_000).alias("u"))
    df = joins.any_key_match(left, right, [("x", "u")], ["a"], ["b"])
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1002


def test_written_pairs_of_large_keys_are_small(spark, tmp_path):
    """Left rows of one key after the other, each with the same few right ids; in the order of left ids it would be several bytes a pair."""
    left = spark.range(2600).select(F.col("id").alias("a"), (F.col("id") % 26).alias("x"))
    right = spark.range(50_000).select(F.col("id").alias("b"), (F.xxhash64("id") % 26).alias("u"))
    joins.any_key_match(left, right, [("x", "u")], ["a"], ["b"]).write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == left.join(right, F.col("x") == F.col("u")).count()
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < n


def test_outcomes_are_about_each_change_once(spark):
    outcomes = [(1, 10, "t", 1), (2, None, "t", 1), (3, 11, None, 1), (4, 12, "t", None), (5, 10, "u", 2), (5, 10, "u", 2), (6, 99, "t", 1)]
    changes = [(10, "t", 1), (11, "t", 1), (12, "u", 2), (12, "u", 2), (13, None, None), (10, "v", 3)]
    df = outcomes_about(spark.createDataFrame(outcomes, "outcome_id long, sha long, task string, attempt int"), spark.createDataFrame(changes, "sha long, task string, attempt int"))
    want = {(s, o) for o, x, t, n in outcomes for s, u, m in changes if x == s or (t is not None and n is not None and (t, n) == (u, m))}
    got = [tuple(r) for r in df.select("sha", "outcome_id").collect()]
    assert len(got) == len(want)
    assert set(got) == want


def test_links_by_the_clock_broadcast_no_captures(spark):
    """Captures of a second to two years; the exploded ones look small to the planner, but must not be broadcast."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    captures = [(i, i % 5, start + dt.timedelta(seconds=rng.randrange(10**7))) for i in range(40)]
    captures = [(i, r, s, s + dt.timedelta(seconds=rng.choice([0, 1, 3600, 10**5, 10**6, 6 * 10**7]))) for i, r, s in captures]
    commits = [(rng.randrange(6), k, start + dt.timedelta(seconds=rng.randrange(2 * 10**7))) for k in range(200)] + [(r, 1000 + i, e + dt.timedelta(seconds=600)) for i, r, _, e in captures]
    made = spark.createDataFrame(commits, "repo long, sha long, at timestamp_ntz").withColumns({"parent": F.lit(None).cast("long"), "patch": F.lit(None).cast("string")})
    own = spark.createDataFrame(captures, "capture long, repo long, start timestamp_ntz, end timestamp_ntz")
    none = spark.createDataFrame([], "capture long, head long, diff string, trigger string"), spark.createDataFrame([], "capture long, sha long, rung string")
    df = linking.confidence(made, own, *none, heuristic=True, width=3600)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(i, k) for r, k, at in commits for i, q, s, e in captures if r == q and s <= at <= e + dt.timedelta(seconds=600)}
    got = [(r.capture, r.sha) for r in df.collect()]
    assert len(got) == len(want)
    assert set(got) == want
