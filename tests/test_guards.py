"""Guards, cleaning, commands and diffs on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning, paths
from tidemark.operators import calls as C
from tidemark.operators import guards as G
from tidemark.sources import git, otlp
from tidemark.sources.store import Store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_words_are_refused_before_anything_is_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    good, bad = (spark.createDataFrame([(t,)], "text string") for t in ("a plain one", "It would impact"))
    G.emit(store, "reports", good, "text")
    with pytest.raises(ValueError, match="impact, would"):
        G.emit(store, "reports", bad, "text")
    assert store.table("reports").count() == 1


def test_gaps_and_covariates_are_refused(spark):
    rows = spark.createDataFrame([(0, 1, None), (1, None, None)], "i int, a int, b int")
    with pytest.raises(ValueError, match="column a .* row 1"):
        G.refuse_on_gaps(rows, "i", ["a"])
    assert G.refuse_on_gaps(rows.where("i = 0"), "i", ["a"]).count() == 1 and G.refuse_on_gaps(rows.limit(0), "i", ["a"]).count() == 0
    chosen = spark.createDataFrame([(f"c{k}", True) for k in range(16)], "column string, chosen boolean")
    with pytest.raises(ValueError, match="16 covariates"):
        G.capped(chosen)
    assert G.capped(chosen.where("column <> 'c3'")).count() == 15


def test_columns_without_rows_keep_their_words(spark):
    rows = spark.createDataFrame([], "a int, b int")
    _, words = G.blank_unobservable(rows, {"a": "observed", "b": "unavailable"})
    assert {r.column: r.coverage for r in words.collect()} == {"a": "observed", "b": "unavailable"}


def test_scenario_faults(spark):
    paths_ = [
        ("s", "tokens", [1.0, 2.0]), ("t", "tokens", [1.0, -1.0]), ("t", "y", [1.0, 1.0]), ("u", "nothing", [1.0]), ("u", "fixed", [1.0, None]), ("v", "ratio", [-1.0, float("nan")]), ("w", "ratio", [0.0, 0.0]), ("w", "ratio", [0.0, 0.0]),
    ]
    columns = spark.createDataFrame([("tokens", True, True), ("ratio", True, False), ("fixed", False, False), ("y", True, False)], "column string, declarable boolean, count boolean")
    got = G.scenario_faults(spark.createDataFrame(paths_, "scenario string, column string, values array<double>"), columns, 2, "y").collect()
    assert sorted(map(tuple, got)) == sorted([
        ("t", "tokens", "negative"), ("t", "y", "is_target"), ("u", "nothing", "unknown_column"), ("u", "nothing", "wrong_length"), ("u", "fixed", "not_declarable"), ("u", "fixed", "hole"), ("v", "ratio", "not_finite"), ("w", "ratio", "repeated"),
    ])


def test_steps_outside_of_a_horizon(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([1],)], "actual array<int>")
    assert [r.actual for r in G.scored(rows, [1, 3], ["actual"]).collect()] == [[1, 3], None]


@pytest.mark.parametrize(("text", "want"), [
    ("bash -lc 'a b'", "a b"), ("/usr/bin/zsh -c ls", "ls"), ("ssh -c 'x'", "ssh -c 'x'"), ("bash -c", "bash -c"), (None, None), ("bash -lx 'a'", "bash -lx 'a'"),
])
def test_unshell(spark, text, want):
    assert one(spark, C.unshell(F.col("t")), t=text) == want


def test_renormalise_is_idempotent(spark):
    for text in ("A=b C=d run --x=y -z /a/b | Weird && 7z", "", "_ _ ; x", "git Commit MSG"):
        once = one(spark, C.renormalise(F.col("t")), t=text)
        assert one(spark, C.renormalise(F.col("t")), t=once) == once
    assert one(spark, C.renormalise(F.col("t")), t="A=b C=d run --x=y | Weird") == "A= C= run --x | Weird"


def test_paths(spark):
    at = lambda p, repo="/repo", home="/h": one(spark, paths.relativize(F.col("p"), F.col("r"), F.col("h")), p=p, r=repo, h=home)
    assert [at(p) for p in ("/repo", "/repo/a/../b", "x//y", "", "/repo/", None)] == [".", "b", "x/y", None, ".", None]
    assert at("/repo2/a").startswith("<outside>/") and at("~") == at("/h") and at("../x") == at("/x") and at("a", None) == "a"
    assert one(spark, paths.relativize(F.col("p"), F.lit("/"), F.lit("/h")), p="/a/b") == "a/b"
    assert one(spark, paths.prose(F.col("t"), F.lit("/repo"), F.lit("/h")), t="no path, a/b http://x/y") == "no path, a/b http://x/y"


def test_cleaning_kinds_and_bounds(spark):
    clean = lambda v, **kw: one(spark, cleaning.clean_json(F.col("t"), "f", **kw), t=v if isinstance(v, str) or v is None else json.dumps(v))
    assert clean({"n": 1, "s": "x"}, kind="size").payload == '{"n":1}' and clean({"s": "x"}, kind="size").notes == ["dropped:f:not_a_number"]
    r = clean(list(range(300)))
    assert len(json.loads(r.payload)) == 256 and r.notes == ["cut:f:items"]
    assert len(json.loads(clean("\"" + "a" * 900 + "\"", kind="enum").payload)) == 64
    assert clean("null").payload == "null" and clean(None).payload is None and clean("nope").notes == ["dropped:f:json"]
    assert clean({"prompt": "x", "é": None}, refused=("prompt",)).payload == '{"é":null}'


def test_diffs_by_hunk_lengths(spark):
    diff = "\n".join([
        "diff --git a/q.sql b/q.sql", "--- a/q.sql", "+++ b/q.sql", "@@ -1,3 +1,3 @@", "--- drop this comment", "+++ plus plus", "-second line", "+-- another", " context", "\\ No newline at end of file",
        "--- /dev/null", "+++ b/new.txt", "@@ -0,0 +1 @@", "+fresh line", "--- a/gone", "+++ /dev/null", "@@ -1 +0,0 @@", "-gone line",
    ])
    got = {tuple(r) for r in git.diff_lines(spark.createDataFrame([(diff,)], "d string"), "d").collect()}
    assert got == {
        ("q.sql", "removed", "-- drop this comment"), ("q.sql", "added", "++ plus plus"), ("q.sql", "removed", "second line"), ("q.sql", "added", "-- another"), ("new.txt", "added", "fresh line"), ("gone", "removed", "gone line"),
    }


def test_numstat_with_nulls(spark):
    text = "1\t2\ta b.py\0-\t-\tbin\0003\t0\t\0old\tname\0new\0004\t1\tcut"
    rows = [tuple(r) for r in git.numstat_z(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t").collect()]
    assert rows == [("a b.py", None, 1, 2), ("bin", None, None, None), ("new", "old\tname", 3, 0), ("cut", None, 4, 1)]


def test_otlp_values(spark):
    got = lambda v: one(spark, otlp.value_json(F.col("v")), v=v)
    assert got('{"intValue":"x1"}') == '"x1"' and got('{"bytesValue":"aa"}') is None and got("3") is None and got(None) is None
    assert got('{"kvlistValue":{"values":[{"key":"a"},{"nokey":1},7]}}') == '{"a":null}' and got('{"arrayValue":{}}') == "[]"


def test_store_of_series_and_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for name, clock in (("s1", "day"), ("s2", "week"), ("s1", "day")):
        store.put_series(spark.createDataFrame([(0, 1.0, clock), (1, 2.0, clock)], "row_index int, y double, clock string"), name)
    assert store.series("s1").count() == 2 and store.series("s9").count() == 0
    assert [tuple(r) for r in store.series_list("week").collect()] == [("s2", "week", 2)] and store.series_list().count() == 2
    run = spark.createDataFrame([("s1", "y", 4, "drift", "adds")], "series_id string, target string, horizon int, model string, label string")
    store.put_run(run)
    store.put_run(run.withColumn("label", F.lit("none")))
    assert [r.label for r in store.runs_of("s1").collect()] == ["adds", "none"] and store.runs_of("s2").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        store.put_run(run.drop("label"))
    store.diagnose(spark.createDataFrame([("k", "d", 1), ("k", "e", 2)], "kind string, detail string, capture_id int"))
    assert store.diagnostics().count() == 2 and store.diagnostics(2).first().detail == "e"
    with pytest.raises(ValueError):
        store.append_checked("outcomes", run, ["task"])


def test_repetitions_and_bindings(spark):
    tasks = spark.createDataFrame([("b", 1), ("a", 0)], "task string, i int")
    assert [tuple(r) for r in G.repetition_order(tasks, "task", "i", 2).orderBy("turn").collect()] == [(0, 0, "a"), (1, 0, "b"), (2, 1, "a"), (3, 1, "b")]
    rows = spark.createDataFrame([(1, 1, None, True), (1, 2, "/a", False), (1, 3, "/b", False), (2, 1, None, True)], "k int, o int, cwd string, end boolean")
    assert sorted(map(tuple, G.first_binding(rows, "k", "o", "cwd").collect()), key=str) == [(1, "/a", False), (2, None, False)]


def test_replay_is_in_order(spark):
    posts = spark.createDataFrame([(2.0, "p", 1, "b"), (1.0, "p", 2, "a")], "at double, file string, line int, body string")
    lines = spark.createDataFrame([("f2", 1, "d"), ("f1", 2, "c2"), ("f1", 1, "c1")], "file string, line int, body string")
    assert [r.body for r in G.replay_order(posts, lines).collect()] == ["a", "b", "c1", "c2", "d"]
