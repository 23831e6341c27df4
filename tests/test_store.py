"""The Parquet store and the linear models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.sources import exports, store, surfaces


def test_store_replaces_sessions_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"c{i % 5}", i, "a" if i % 2 else "b") for i in range(50)], "capture_id string, v int, kind string")
    s.append("activities", rows)
    assert s.session("activities", "c1").count() == 10 and s.session("activities", "c1", ["a"]).count() == 5
    fresh = spark.createDataFrame([("c1", 999, "a")], rows.schema)
    for _ in range(2):  # again gives the same
        s.replace("activities", fresh, fresh)
        assert s.session("activities", "c1").collect() == [("c1", 999, "a")]
        assert s.table("activities").count() == 41
    s.replace("activities", rows.limit(0), fresh)  # a session without rows is gone
    assert s.session("activities", "c1").count() == 0 and s.table("activities").count() == 40
    assert s.by_id("activities", rows.where("v < 10 and capture_id != 'c1'").select("v"), "v").count() == 8
    assert s.of_kind("activities", "a").where("kind != 'a'").count() == 0


def test_rebuild_and_series(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append("observations", spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "capture_id string, v int"))
    steps = [("activities", lambda d: d.withColumn("w", F.col("v") * 2)), ("evidence", lambda d: d.groupBy("capture_id").agg(F.sum("w").alias("total")))]
    for _ in range(2):
        s.rebuild(steps)
        assert {tuple(r) for r in s.table("evidence").drop("bucket").collect()} == {("a", 6), ("b", 10)}
    for n in (3, 2):
        s.put_series(spark.range(n), "x")
        s.put_series(spark.range(n + 1), "y")
    assert {(r.series_id, r["count"]) for r in s.table("series").groupBy("series_id").count().collect()} == {("x", 2), ("y", 3)}
    s.diagnose(spark.createDataFrame([("k", "d" * 5000)], "kind string, detail string"))
    assert len(s.table("diagnostics").first().detail) == 2048


def test_column_contract_and_shedding(spark):
    df = spark.createDataFrame([("otel.metric.x",), ("hook",), (None,)], "kind string")
    with pytest.raises(ValueError, match="missing columns .*b.*extra columns .*kind"):
        store.assert_columns(df, ["b"])
    assert [r.d for r in df.select(store.droppable("kind").alias("d")).collect()] == [True, False, None]


def test_ridge_and_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1]
    label = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for (a, b), c, d in zip(x, y, label, strict=True)], "a double, b double, y double, z int")
    assert np.allclose(models.ridge(df, ["a", "b"], "y", 1e-9), [1, 2, -3], atol=1e-6)
    w = models.logistic(df, ["a", "b"], "z", 1.0)
    design = np.column_stack([np.ones(400), x])
    grad = design.T @ (label - 1 / (1 + np.exp(-design @ w))) - np.array([0, w[1], w[2]])
    assert np.abs(grad).max() < 1e-5
    scaled, _ = models.standardised(df.withColumn("c", F.lit(1.0)), ["a", "c"])
    r = scaled.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("c").alias("c")).first()
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 and r.c == 0


def test_hints(spark):
    bodies = ['{"session_id":"a"}', '{"sessionId":"b"}', '{"thread_id":"c"}', '{"payload":{"id":"d"}}', "{bad", None]
    got = [r.h for r in spark.createDataFrame([(b,) for b in bodies], "v string").select(surfaces.session_hint("v").alias("h")).collect()]
    assert got == ["a", "b", "c", "d", None, None]


def contents(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


class Died(Exception):
    pass


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), buckets=8)
    rows = spark.createDataFrame([(f"c{i % 20}", i, i * 1.5) for i in range(100)], "capture_id string, v int, w double")
    s.append("activities", rows)
    s.append("evidence", rows.groupBy("capture_id").agg(F.sum("w").alias("total")))
    return s, rows


def test_a_replacement_that_dies_between_any_two_steps_is_seen_wholly_or_not_at_all(spark, filled):
    s, rows = filled
    old = {n: contents(s.table(n)) for n in ("activities", "evidence")}
    fresh = {"activities": spark.createDataFrame([("c3", 999, 0.5)], rows.schema), "evidence": spark.createDataFrame([("c3", 0.5)], "capture_id string, total double")}
    steps = []
    s.step = steps.append
    probe = store.Transaction(s)
    for n, df in fresh.items():
        probe.replace(n, df, fresh["activities"])
    assert steps == ["layer of activities", "keys of activities", "layer of evidence", "keys of evidence"] and contents(s.table("activities")) == old["activities"]
    seen = []
    for k in range(6):
        count = 0

        def die(name, k=k):
            nonlocal count
            count += 1
            if count == k + 1:
                raise Died(name)

        s.step = die
        with pytest.raises(Died) as e:
            s.replace_all(fresh, fresh["activities"])
        s.step = lambda name: None
        now = {n: contents(s.table(n)) for n in old}
        whole = now != old
        seen.append((str(e.value), whole))
        if whole:
            assert now["evidence"].count("('c3', 0.5)") == 1 and sum("999" in r for r in now["activities"]) == 1 and len(now["activities"]) == 96
    assert seen[-2:] == [("before the manifest", False), ("after the manifest", True)] and not any(w for _, w in seen[:-1])
    # what the dead ones left goes, and nothing else
    before = {n: contents(s.table(n)) for n in old}
    assert s.vacuum(grace=3600) == [] and len(s.vacuum(grace=0)) > 10
    assert {n: contents(s.table(n)) for n in old} == before and s.vacuum(grace=0) == []
    layers = {x["id"] for n in old for x in s.pin().entries[n]["layers"]}
    assert {n.split("=")[1] for t in old for n in s.files.names(s.path(t)) if n.startswith("layer=")} == layers


def test_readers_keep_the_version_that_they_have_pinned(spark, filled):
    s, rows = filled
    pinned = s.pin()
    held = pinned.table("activities")
    old = contents(held)
    s.replace("activities", rows.limit(0), spark.createDataFrame([(f"c{i}",) for i in range(20)], "capture_id string"))
    s.append("activities", rows.limit(3))
    assert contents(held) == old == contents(s.pin(pinned.version).table("activities")) and s.table("activities").count() == 3
    assert len(s.pin().entries["activities"]["layers"]) == 3 and len(s.pin().entries["activities"]["layers"][0]["hidden"]) == 7  # all buckets that have rows


def test_of_two_replacements_at_once_the_later_starts_again(spark, filled):
    s, rows = filled
    one, two = store.Transaction(s), store.Transaction(s)
    key = lambda c: spark.createDataFrame([(c,)], "capture_id string")
    one.replace("activities", spark.createDataFrame([("c1", 1, 1.0)], rows.schema), key("c1"))
    two.replace("activities", spark.createDataFrame([("c2", 2, 2.0)], rows.schema), key("c2"))
    three = store.Transaction(s)
    three.append("activities", spark.createDataFrame([("c9", 9, 9.0)], rows.schema))
    one.commit()
    with pytest.raises(store.Conflict):
        two.commit()
    three.commit()  # what is appended goes with anything
    tried = []

    def work(t):
        tried.append(t.base.version)
        t.replace("activities", spark.createDataFrame([("c2", 2, 2.0)], rows.schema), key("c2"))
        if len(tried) == 1:
            s.append("activities", spark.createDataFrame([("c2", 77, 7.0)], rows.schema))

    s.change(work)
    assert len(tried) == 2 and s.session("activities", "c2").collect() == [("c2", 2, 2.0)]
    assert s.session("activities", "c1").collect() == [("c1", 1, 1.0)] and s.session("activities", "c9").count() == 6


def test_columns_are_added_and_types_are_held(spark, filled):
    s, rows = filled
    s.append("activities", spark.createDataFrame([("c1", 5, 1.0, "new")], "capture_id string, v int, w double, note string"))
    assert s.table("activities").columns == ["capture_id", "v", "w", "note"] and s.table("activities").where("note is null").count() == 100
    with pytest.raises(ValueError, match="another type"):
        s.append("activities", spark.createDataFrame([("c1", "x")], "capture_id string, v string"))
    s.rebucket("activities", 3)
    assert s.pin().entries["activities"]["buckets"] == 3 and s.session("activities", "c1").count() == 6 and s.table("activities").count() == 101
    s.purge(spark.createDataFrame([("c1",)], "capture_id string"))
    assert s.session("activities", "c1").count() == 0 and s.session("evidence", "c1").count() == 0 and s.table("evidence").count() == 19
    assert [r.total for r in s.evidence("c2", metric="total").collect()] == [315.0]


STEPS = [("activities", lambda d: d.withColumn("twice", F.col("v") * 2)), ("evidence", lambda d: d.groupBy("capture_id").agg(F.sum("twice").alias("total"), F.count("*").alias("n")))]


def test_rebuild_of_what_has_changed_equals_a_full_one_and_reads_only_its_buckets(spark, tmp_path):
    s, full = (store.Store(spark, str(tmp_path / n), buckets=16) for n in ("a", "b"))
    rows = spark.createDataFrame([(f"c{i % 50}", i) for i in range(500)], "capture_id string, v int")
    s.append("observations", rows)
    assert s.rebuild(STEPS) == {"activities": "full", "evidence": "full"}
    assert s.rebuild(STEPS) == {"activities": "kept", "evidence": "kept"}
    read = []

    def watched(d):
        plan = d._jdf.queryExecution().executedPlan().toString()
        read.append(plan)
        return STEPS[0][1](d)

    late = spark.createDataFrame([("c3", -5), ("new", 1)], rows.schema)
    s.append("observations", late)
    s.purge(spark.createDataFrame([("c7",)], "capture_id string"), ["observations"])
    before = s.pin()
    assert s.rebuild([("activities", watched), STEPS[1]]) == {"activities": "changed", "evidence": "changed"}
    dirty = {r.b for r in store.Store.bucketed(spark.createDataFrame([("c3",), ("new",), ("c7",)], "capture_id string"), "capture_id", 16).select(F.col("bucket").alias("b")).collect()}
    assert all(f"bucket#" in p and "PartitionFilters" in p for p in read)
    new = s.pin().entries["evidence"]["layers"][-1]["id"]
    assert {r.bucket for r in s.pin().scan("evidence").where(F.col("layer") == new).select("bucket").distinct().collect()} <= dirty and len(dirty) < 16
    full.append("observations", s.table("observations"))
    full.rebuild(STEPS)
    for n, _ in STEPS:
        assert contents(s.table(n)) == contents(full.table(n))
    assert s.table("evidence").where("capture_id = 'c7'").count() == 0 and before.table("evidence").where("capture_id = 'c7'").count() == 1
    # another version of a reducer rebuilds its table wholly, and those after it follow
    assert s.rebuild(STEPS, reducers={"evidence": "2"}) == {"activities": "kept", "evidence": "full"} and s.pin().reducers() == {"activities": None, "evidence": "2"}
    assert s.rebuild(STEPS, reducers={"evidence": "2"}, full=True) == {"activities": "full", "evidence": "full"}
    assert contents(s.table("evidence")) == contents(full.table("evidence"))


def test_rows_that_come_during_a_rebuild_are_reduced_by_the_next(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    schema = "capture_id string, v int"
    s.append("observations", spark.createDataFrame([("a", 1), ("b", 2)], schema))
    s.rebuild(STEPS)
    s.append("observations", spark.createDataFrame([("a", 10)], schema))

    def slow(d):
        if not came:
            came.append(1)
            s.append("observations", spark.createDataFrame([("b", 20)], schema))
        return STEPS[0][1](d)

    came = []
    s.rebuild([("activities", slow), STEPS[1]])
    assert {(r.capture_id, r.total) for r in s.table("evidence").collect()} == {("a", 22), ("b", 4)}
    s.rebuild([("activities", slow), STEPS[1]])
    assert {(r.capture_id, r.total) for r in s.table("evidence").collect()} == {("a", 22), ("b", 44)}


@pytest.mark.parametrize("fmt", ["parquet", "jsonl"])
def test_export_of_one_version_while_rows_come(spark, tmp_path, fmt):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"c{i % 7}", i, None if i % 3 else 0.5, [i, None]) for i in range(90)], "capture_id string, v int, w double, l array<int>")
    s.append("observations", rows)
    s.rebuild([("activities", lambda d: d.select("capture_id", F.col("v").alias("u")))], reducers={"activities": "a-7"})
    s.change(lambda t: t.append("runs", spark.createDataFrame([(1, "x")], "run int, label string")))
    pinned, out = s.pin(), str(tmp_path / "out")
    s.step = lambda name: None
    s.append("observations", rows)
    manifest = exports.export(pinned, out, fmt, order={"observations": ["v"]})
    back = exports.read_export(spark, out)
    assert sorted(back) == ["activities", "observations", "runs"] and manifest["version"] == pinned.version
    assert {n: (t["rows"], t["reducer"]) for n, t in manifest["tables"].items()} == {"activities": (90, "a-7"), "observations": (90, None), "runs": (1, None)}
    for n in back:
        assert contents(back[n]) == contents(pinned.table(n)) and back[n].schema == pinned.table(n).schema
    assert s.table("observations").count() == 180
    with pytest.raises(ValueError, match="holds an export"):
        exports.export(pinned, out, fmt)
    one = exports.export(pinned, str(tmp_path / "one"), fmt, capture_id="c3")
    assert {n: t["rows"] for n, t in one["tables"].items()} == {"activities": 13, "observations": 13, "runs": 1}
    if fmt == "jsonl":
        line = spark.read.text(f"{out}/observations").orderBy("value").first().value
        assert line == '{"capture_id":"c0","l":[0,null],"v":0,"w":0.5}'
    # rows that are lost, and an export that died before its manifest
    next(p for p in (tmp_path / "out" / "activities").glob("part-*")).unlink()
    with pytest.raises(ValueError, match="the manifest says"):
        exports.read_export(spark, out)
    (tmp_path / "dead").mkdir()
    with pytest.raises(ValueError, match="holds no export"):
        exports.read_export(spark, str(tmp_path / "dead"))
