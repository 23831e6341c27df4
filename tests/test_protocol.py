"""Forecasters as functions of windows, paired runs, links by trees and clocks, and ranked sources."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as L
from tidemark.operators import forecasters as P
from tidemark.operators import linking, resolve

SERIES = "series_id string, ordering string, row_index long, y double, regime_start long, changepoint boolean, load double"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(6)
    rows = []
    for name, n in (("a", 140), ("b", 150), ("short", 5)):
        cut = 40 if name == "b" else 0
        for i in range(n):
            y = None if name == "a" and i in (33, 34) else round(rng.gauss(10, 3), 3)
            rows.append((name, "true", i, y, cut if i >= cut else 0, name == "b" and i == cut, float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, SERIES), rows


def test_any_function_of_a_window_is_a_forecaster(spark, series, monkeypatch):
    df, rows = series
    seen = {}
    for s, _, i, y, _, _, load in rows:
        seen.setdefault(s, []).append((y, load))

    def guess(w):
        assert len(w.context) == len(w.past["load"]) == w.origin - w.ctx_start and len(w.future["load"]) == len(w.context) + w.horizon
        return [float(w.context[-1] + w.future["load"][w.origin - w.ctx_start + k]) for k in range(w.horizon)]

    monkeypatch.setattr(P, "BLOCK", 10)
    got = P.run_forecaster(df, 3, P.Named("guess", guess), past=["load"], future=["load"]).collect()
    kept = {(r.series_id, r.origin) for r in L.plan(df.drop("load"), 3).where("dropped is null").collect()}
    assert len(got) == len(kept) > 10 and {(r.series_id, r.origin) for r in got} == kept
    for r in got:
        line = seen[r.series_id]
        point = [line[r.origin - 1][0] + line[r.origin][1]] * 3  # nothing behind the origin is known: its load stays
        actual = [line[r.origin + k][0] for k in range(3)]
        assert r.actual == actual and r.point == pytest.approx(point) and r.fault is None and r.forecaster == "guess"
        assert r.mae == pytest.approx(sum(abs(a - b) for a, b in zip(actual, point)) / 3, abs=1e-6) and r.last_context == line[r.origin - 1][0]


def test_a_forecasters_own_failures_cost_their_windows_only(spark, series):
    df, _ = series

    def odd(w):
        k = w.origin // 3 % 4
        return [[1.0], [float("nan")] * 3, [1, 2, 3], None][k]

    got = P.run_forecaster(df, 3, P.Named("odd", odd)).collect()
    assert {r.fault for r in got} == {"wrong_length", "not_finite", None, "TypeError"}
    assert all((r.mae is None) == (r.point is None) == (r.fault is not None) for r in got)


def test_own_forecaster_equals_the_built_in_one_and_pairs(spark, series):
    df, _ = series
    mean8 = P.run_forecaster(df, 3, P.Named("mean8", lambda w: [float(w.context[-8:].mean())] * 3))
    base = L.backtest(df.drop("load"), 3)
    want = {(r.series_id, r.origin): r.mae for r in base.where("forecaster = 'rolling_mean'").collect()}
    got = {(r.series_id, r.origin): r.mae for r in mean8.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    last = {(r.series_id, r.origin): r.mae for r in base.where("forecaster = 'persistence'").collect()}
    for r in P.paired(mean8, base.where("forecaster = 'persistence'")).collect():
        d = [got[k] - last[k] for k in got if k[0] == r.series_id]
        assert r.n == len(d) and r["shift"] == pytest.approx(median(d), abs=1e-9) and r.wins == pytest.approx(sum(x < 0 for x in d) / len(d))


def test_rungs_of_the_ladder(spark):
    t = datetime(2026, 3, 1, 12)
    at = lambda s: t + timedelta(seconds=s)
    commits = [("r", "c1", "c0", "p1", at(0)), ("r", "c2", "c1", "p2", at(50)), ("r", "c3", "c2", "p3", at(700)), ("r", "c4", None, "p4", at(200)), ("r", "old", "x", "p5", at(-5)), ("r", "far", "c3", "p6", at(5000)), ("other", "c9", "c8", "p1", at(10))]
    captures = [("k", "r", t + timedelta(microseconds=500_000), at(600)), ("q", "r", at(0), at(10))]
    snaps = [("k", "c0", "p1", "change"), ("k", "c2", linking.EMPTY, None), ("k", "c2", "p3", "change"), ("k", "old", linking.EMPTY, "change"), ("k", "c8", "p1", "change"), ("q", "c1", linking.EMPTY, "capture_end"), ("q", None, "p1", "change")]
    said = [("k", "far", "provider_reported"), ("k", "gone", "explicit"), ("k", "c2", "provider_reported"), ("k", "c2", "explicit")]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    args = (
        make(commits, "repo string, sha string, parent string, patch string, at timestamp_ntz"), make(captures, "capture string, repo string, start timestamp_ntz, end timestamp_ntz"),
        make(snaps, "capture string, head string, diff string, trigger string"), make(said, "capture string, sha string, rung string"),
    )
    sure = {("k", "c1"): "tree_match_during", ("k", "c3"): "tree_match_after", ("k", "c2"): "explicit", ("k", "far"): "provider_reported", ("k", "gone"): "explicit", ("q", "c1"): "tree_match_after"}
    got = linking.confidence(*args).collect()
    assert {(r.capture, r.sha): r.rung for r in got} == sure and {r.sha for r in got if not r.known} == {"gone"}
    timed = {("k", "c4"): "heuristic", ("q", "c2"): "heuristic", ("q", "c4"): "heuristic"}
    for width in (60, 100_000):
        assert {(r.capture, r.sha): r.rung for r in linking.confidence(*args, heuristic=True, width=width).collect()} == sure | timed


def test_ranked_sources(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "y", 7), (4, None, None)], "id int, a string, b int")
    told = resolve.first_telling(rows, "id", [("one", rows.where("id = 3").select("id")), ("two", rows.where("id in (2, 3)").select("id").union(rows.where("id = 2").select("id")))])
    assert {(r.id, r.told_by) for r in told.collect()} == {(1, None), (2, "two"), (3, "one"), (4, None)}
    value, source = resolve.first_known({"a": F.col("a"), "b": F.col("b").cast("string")})
    assert [(r.v, r.s) for r in rows.select(value.alias("v"), source.alias("s")).collect()] == [("x", "a"), ("5", "b"), ("y", "a"), (None, None)]
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, i string")
    assert {tuple(r) for r in resolve.sole_identity(same, ["k"], "i").collect()} == {(1, "a", 1), (2, None, 2), (3, None, 0)}
