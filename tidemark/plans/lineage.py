"""Queries over commits, outcomes, guards and experiments, staged from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from ..operators import lineage as L
from ..operators import linking as N
from ..operators import resolve as R
from .calls import _listed, _pick
from .staging import table

WORDS = (*L.LADDER, L.UNLINKED, "rumour")
STATUS = ("passed", "FAILED", "maybe", "ok")
REPORTS = ("a plain report", "this would cause an impact", "Causing trouble", "because it was caused; causal", "WOULD", "impacted impacts")
FOUND = ("", "cause,impact,would", "causing", "caused", "would", "impacted,impacts")


def _links(spark, d):
    k = F.col("l_suppkey") + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("sha"), (F.col("l_partkey") % 500).alias("tree"), _pick(WORDS, k).alias("word"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("activity"))


def q_best_rung(spark, d):
    return L.best_rung(_links(spark, d), "sha", "word", ["l_orderkey", "l_linenumber"], "activity")


def _base(spark, d):
    return table(spark, d, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("sha"), (F.col("p_partkey") % 500).alias("tree"))


def q_commit_links(spark, d):
    rows, _ = L.commit_links(_links(spark, d).select("sha", "tree", "activity"), _base(spark, d), "sha", "tree", "activity")
    return rows.select("row_sha", "twin", "n_links", F.array_join("activities", ",").alias("activities"))


def q_refused_links(spark, d):
    _, refused = L.commit_links(_links(spark, d).select("sha", "tree", "activity"), _base(spark, d), "sha", "tree", "activity")
    return refused


def _outcomes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("outcome_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("sha"), F.when(k % 2 == 0, F.concat(F.lit("t"), F.col("o_custkey") % 50)).alias("task"), F.when(k % 5 != 0, (k % 4).cast("int")).alias("attempt"),
        F.col("o_custkey").alias("change"), (k % 3 != 1).alias("verifies"), F.when(k % 4 != 0, k % 1000).alias("duration_ms"), _pick(STATUS, k).alias("status"),
    )


def q_outcomes_about(spark, d):
    changes = table(spark, d, "customer").select(F.col("c_custkey").alias("sha"), F.concat(F.lit("t"), F.col("c_custkey") % 50).alias("task"), (F.col("c_custkey") % 4).cast("int").alias("attempt"))
    return L.outcomes_about(_outcomes(spark, d).select("outcome_id", "sha", "task", "attempt"), changes)


def q_merge_verification(spark, d):
    return L.merge_verification(_outcomes(spark, d), "change", F.col("verifies"), ["outcome_id"])


def q_lineage_cohort(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("capture_id"), F.col("o_orderpriority").alias("provider"), F.when(F.col("o_orderkey") % 6 == 0, "late").alias("dropped"))
    return L.cohort_record(rows, "o_custkey")


def q_refuse_words(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(G.forbidden_words(_pick(REPORTS, F.col("o_orderkey"))), ",").alias("words"))


def q_row_faults(spark, d):
    rules = {"version": F.col("o_orderstatus").isin("F", "O"), "total": F.col("o_totalprice") > 1000, "clerk": F.when(F.col("o_orderkey") % 9 != 0, F.length("o_orderpriority") > 0)}
    return G.row_faults(table(spark, d, "orders"), rules).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


def _gapped(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 5, F.col("o_custkey")).alias("a"), F.lit(None).cast("long").alias("b"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderkey") > 100, 1).alias("e"))


COVERAGE = {"a": "observed", "b": "observed", "c": "unavailable", "e": "partial"}


def q_blank_unobservable(spark, d):
    rows, _ = G.blank_unobservable(_gapped(spark, d), COVERAGE)
    return rows


def q_column_coverage(spark, d):
    _, words = G.blank_unobservable(_gapped(spark, d), COVERAGE)
    return words


def q_first_gaps(spark, d):
    return G.first_gaps(_gapped(spark, d), "o_orderkey", ["a", "c", "e"])


def q_variant(spark, d):
    coverage = table(spark, d, "nation").select(F.col("n_name").alias("column"), _pick(("observed", "derived", "partial", "unavailable"), F.col("n_nationkey")).alias("coverage"))
    return G.variant(coverage, "NATION_3").unionByName(G.variant(coverage, "NATION_3", ["NATION_0", "NATION_2", "NATION_3", "nowhere"]))


def q_scored_steps(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("actual"))
    return G.scored(rows, [1, 3], ["actual"]).select("l_orderkey", F.array_join("actual", ",").alias("steps"))


def q_silent_surfaces(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.select("user_id", F.array_join(G.silent_surfaces(F.lit(["view", "click", "purchase", "error", "signup", "hook"]), F.col("seen")), ",").alias("silent"))


def q_ingest_health(spark, d):
    e = table(spark, d, "events").withColumn("dropped", F.get_json_object("props", "$.k").cast("int") % 10 == 0)
    return G.health(e, "event_type", "ts", F.col("dropped"))


def q_status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("runs"))


def q_metric_union(spark, d):
    vectors = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).cast("double").alias("value"), F.max(F.col("o_orderkey") % 2 == 0).alias("stream"))
    return G.filled_union(vectors, "o_custkey", "o_orderpriority", "value", F.col("stream"))


def q_mixed_conditions(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 400 != 0, F.when(F.col("c_nationkey") % 2 == 0, "one").otherwise(F.col("c_mktsegment"))).alias("print"))
    return G.mixed_conditions(rows, "c_nationkey", "print")


def q_claims(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("t"), F.col("o_custkey"))).alias("task"), (F.col("o_orderkey") % 5).cast("int").alias("attempt"))
    return G.claims(rows, "task", "attempt", "o_orderkey")


def q_repetition_order(spark, d):
    return G.repetition_order(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_name", "n_nationkey", 3)


def q_calibration_summary(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_partkey") % 30 != 0, F.col("l_quantity").cast("double")).alias("y"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: k * F.when(F.col("l_linenumber") == 1, 5.0).otherwise(4.0)).alias("band"))
    g = G.calibration_summary(rows, ["l_returnflag"], "y", "band")
    return g.select("l_returnflag", "n", F.round("max_deviation", 6).alias("max_deviation"), F.round("coverage80", 6).alias("coverage80"), "flagged")


#: declared paths in ascending order, and the fault of each
PATHS = (((1.0,), "wrong_length"), ((1.0, None), "hole"), ((1.0, -2.0), "negative"), ((1.0, 2.0), None), ((float("inf"), 0.0), "not_finite"))
DECLARED = (("tokens", True, True), ("ratio", True, False), ("fixed", False, False), ("y", True, False))


def q_scenario_faults(spark, d):
    """Customers as scenarios: of each column the least path that an order declares; each seventh customer declares all twice."""
    k = F.col("o_orderkey")
    values = F.array(*[F.array(*[F.lit(x).cast("double") for x in path]) for path, _ in PATHS])
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), _pick(("tokens", "ratio", "y", "fixed", "other"), k).alias("column"), F.element_at(values, (F.floor(k / 5) % 5 + 1).cast("int")).alias("values"))
    columns = spark.createDataFrame(list(DECLARED), "column string, declarable boolean, count boolean")
    one = p.groupBy("scenario", "column").agg(F.min("values").alias("values"))
    return G.scenario_faults(one.unionByName(one.where("scenario % 7 = 0")), columns, 2, "y")


def q_regime_state(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("regime"))
    return G.regime_state(rows, "o_custkey").unionByName(G.regime_state(rows, "o_custkey", pooled=True))


def q_advisory(spark, d):
    targets = table(spark, d, "nation").select(F.col("n_nationkey").alias("target"), (F.col("n_nationkey") % 4 != 0).alias("ready"))
    runs = table(spark, d, "customer").where("c_nationkey % 6 <> 5").select(F.col("c_nationkey").alias("target"), (F.col("c_custkey") % 100).alias("made_at"), F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 2 == 0, "model_adds").otherwise("baseline_sufficient").alias("label"))
    return G.advisory(targets, runs, runs.select("run_id", (F.col("run_id") % 3 == 0).alias("flagged")))


def q_fold_summary(spark, d):
    rows = table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 5).alias("fold")).agg(F.sum((F.col("s_acctbal") * 100).cast("long")).alias("a"), F.sum(F.abs(F.col("s_acctbal") * 100).cast("long")).alias("b"))
    g = G.fold_summary(rows.withColumn("score", F.col("b").cast("double") * 0.8 + F.col("a") * 0.1).withColumn("base", F.col("b").cast("double")), "s_nationkey", "score", "base", 0.15)
    return g.withColumn("mean_gain", F.round("mean_gain", 6))


def q_environment_of_request(spark, d):
    """Each order's environment by way of its first line's supplier; unknown where that names none."""
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    env = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("environment"))
    return R.by_primary(table(spark, d, "orders").select("o_orderkey"), first, env, "o_orderkey", "l_suppkey").select("o_orderkey", "environment")


#: how long behind a capture its commits may come, in this staging
LATE_DAYS = 30


def _linking(spark, d):
    """Customers as captures of their own repositories, their orders as commits, and snapshots and statements about those."""
    k = F.col("o_orderkey")
    day = lambda n: F.make_dt_interval(days=n)
    start = F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")) + day((F.col("c_custkey") % 1000).cast("int"))
    captures = table(spark, d, "customer").select(F.col("c_custkey").alias("capture"), F.col("c_custkey").alias("repo"), start.alias("start"), (start + day((F.col("c_custkey") % 5 * 200).cast("int"))).alias("end"))
    o = table(spark, d, "orders")
    commits = o.select(F.col("o_custkey").alias("repo"), k.alias("sha"), F.when(k % 4 != 0, k - 1).alias("parent"), F.concat(F.lit("d"), k % 3).alias("patch"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    shape = F.when(k % 5 == 0, F.struct(k.alias("head"), F.lit("none").alias("diff"))).when(k % 5 == 1, F.struct((k - 1).alias("head"), F.concat(F.lit("d"), k % 3).alias("diff"))).when(k % 5 == 2, F.struct((k - 1).alias("head"), F.lit("other").alias("diff")))
    trigger = F.when(k % 3 == 0, "capture_end").when(k % 3 == 1, "change")
    snapshots = o.select(F.col("o_custkey").alias("capture"), shape.alias("s"), trigger.alias("trigger")).select("capture", "s.head", "s.diff", "trigger")
    said = o.select(F.col("o_custkey").alias("capture"), F.when(k % 91 == 0, -k - 1).otherwise(k).alias("sha"), F.when(k % 13 == 0, "explicit").when(k % 11 == 0, "provider_reported").alias("rung")).where("rung is not null")
    return commits, captures, snapshots, said


def q_link_ladder(spark, d):
    """Every rung: statements at any time, trees seen during or at the end, and the clock."""
    return N.confidence(*_linking(spark, d), heuristic=True, after=LATE_DAYS * 86_400, empty="none", width=86_400 * 7)


def q_first_binding(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("user_id", "event_id", F.when(k % 4 == 0, F.concat(F.lit("/r"), k % 7)).alias("cwd"), (k % 9 == 0).alias("end"))
    return G.first_binding(e, "user_id", "event_id", "cwd")


def q_import_dry_run(spark, d):
    k = F.col("o_orderkey")
    files = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 20, F.lit("/f"), k, F.lit(".jsonl")).alias("path"), F.when(k % 10 != 0, F.col("o_orderdate")).alias("first_ts"), k.alias("capture_id"))
    stored = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("capture_id"))
    return G.dry_run(files, stored, "project", since="1995-01-01").unionByName(G.dry_run(files, stored, "day", project="p3"))


def q_replay_order(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).cast("double").alias("at"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("body"))
    return G.replay_order(rows.where("line % 2 = 0"), rows.where("line % 2 = 1").drop("at"))


def q_passthrough(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("observation_id"), F.col("event_type").alias("kind"), F.concat(F.when(F.col("event_id") % 2 == 0, "tidemark.").otherwise("other."), F.col("event_type")).alias("type"), F.col("props").alias("payload"))
    return G.passthrough(e, ["error", "signup"])


def q_lifecycle_ordinals(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("event"))
    return G.lifecycle(e, "user_id", "event_id")


LADDER = _listed(WORDS)
LINKS = f"lk AS (SELECT l_partkey AS sha, l_partkey % 500 AS tree, {LADDER}[(l_suppkey + l_linenumber) % 7 + 1] AS word, (l_suppkey + l_linenumber) % 7 AS rank, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS activity FROM lineitem)"
JOINED = f"""{LINKS}, bs AS (SELECT p_partkey AS sha, p_partkey % 500 AS tree FROM part WHERE p_size % 4 = 0), tr AS (SELECT tree, min(sha) AS by_tree, count(*) AS owners FROM bs GROUP BY tree),
  mt AS (SELECT lk.*, owners, coalesce(bs.sha, CASE WHEN owners = 1 THEN by_tree END) AS row_sha FROM lk LEFT JOIN bs USING (sha) LEFT JOIN tr ON tr.tree = lk.tree)"""
OUTCOMES = f"""oc AS (SELECT o_orderkey AS outcome_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 't' || (o_custkey % 50) END AS task, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS attempt,
  o_custkey AS change, o_orderkey % 3 <> 1 AS verifies, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 END AS duration_ms, {_listed(STATUS)}[o_orderkey % 4 + 1] AS status FROM orders)"""
SQL = {
    "best_rung": f"WITH {LINKS} SELECT sha, arg_min(word, rank) AS rung, arg_min(activity, (rank, l_orderkey, l_linenumber)) AS first_activity FROM lk WHERE rank < 6 GROUP BY sha",
    "commit_links": f"""WITH {JOINED} SELECT row_sha, max(sha) FILTER (sha <> row_sha) AS twin, count(*) AS n_links, array_to_string(list_sort(list(DISTINCT activity)), ',') AS activities FROM mt WHERE row_sha IS NOT NULL GROUP BY row_sha""",
    "refused_links": f"WITH {JOINED} SELECT DISTINCT sha, CASE WHEN owners > 1 THEN 'ambiguous_tree' ELSE 'off_base' END AS reason FROM mt WHERE row_sha IS NULL",
    "outcomes_about": f"""WITH {OUTCOMES}, ch AS (SELECT c_custkey AS sha, 't' || (c_custkey % 50) AS task, c_custkey % 4 AS attempt FROM customer)
  SELECT sha, outcome_id FROM (SELECT ch.sha, outcome_id FROM ch JOIN oc ON oc.sha = ch.sha UNION SELECT ch.sha, outcome_id FROM ch JOIN oc ON oc.task = ch.task AND oc.attempt = ch.attempt)""",
    "merge_verification": f"""WITH {OUTCOMES}, l AS (SELECT change, count(*) FILTER (verifies) AS n, arg_max(duration_ms, CASE WHEN verifies THEN outcome_id END) AS x, max(outcome_id) FILTER (verifies) AS last FROM oc GROUP BY change),
  j AS (SELECT l.change, oc.duration_ms, CASE lower(oc.status) WHEN 'passed' THEN 0 WHEN 'ok' THEN 0 WHEN 'failed' THEN 1 END::INTEGER AS failed, n FROM l LEFT JOIN oc ON oc.outcome_id = last)
  SELECT change, duration_ms, failed, CASE WHEN n = 0 THEN 'no_verification' WHEN duration_ms IS NULL THEN 'no_duration' END AS why_no_duration, CASE WHEN n = 0 THEN 'no_verification' WHEN failed IS NULL THEN 'unreadable_status' END AS why_no_flag FROM j""",
    "lineage_cohort": """SELECT o_custkey, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 6 <> 0)), ','), '') AS providers, count(DISTINCT CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END) AS captures,
  count(*) FILTER (o_orderkey % 6 <> 0) AS attempts, count(*) FILTER (o_orderkey % 6 = 0) AS drops FROM orders GROUP BY o_custkey""",
    "refuse_words": f"SELECT o_orderkey, {_listed(FOUND)}[o_orderkey % {len(FOUND)} + 1] AS words FROM orders",
    "row_faults": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'version' END, CASE WHEN o_totalprice <= 1000 THEN 'total' END, CASE WHEN o_orderkey % 9 = 0 THEN 'clerk' END) AS faults FROM orders""",
    "blank_unobservable": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 5 THEN o_custkey END AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, CASE WHEN o_orderkey > 100 THEN 1 END AS e FROM orders",
    "column_coverage": "SELECT * FROM (VALUES ('a', 'observed'), ('b', 'unavailable'), ('c', 'unavailable'), ('e', 'partial')) t(\"column\", coverage)",
    "first_gaps": "SELECT 'a' AS \"column\", min(o_orderkey) AS position FROM orders WHERE o_orderkey % 11 = 5 UNION ALL SELECT 'e', min(o_orderkey) FROM orders WHERE o_orderkey <= 100",
    "variant": """WITH c AS (SELECT n_name AS "column", ['observed', 'derived', 'partial', 'unavailable'][n_nationkey % 4 + 1] AS coverage FROM nation WHERE n_name <> 'NATION_3'),
  w AS (SELECT unnest(['NATION_0', 'NATION_2', 'nowhere']) AS "column")
  SELECT "column", coverage, coverage IN ('observed', 'derived') AS chosen, CASE WHEN coverage NOT IN ('observed', 'derived') THEN 'coverage' END AS why FROM c
  UNION ALL SELECT coalesce(c."column", w."column"), coverage, w."column" IS NOT NULL AND coalesce(coverage IN ('observed', 'derived'), false),
    CASE WHEN coverage IS NULL THEN 'missing' WHEN w."column" IS NULL THEN 'not_named' WHEN coverage NOT IN ('observed', 'derived') THEN 'coverage' END FROM c FULL JOIN w ON c."column" = w."column\"""",
    "scored_steps": "WITH a AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS a FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN len(a) >= 3 THEN a[1] || ',' || a[3] END AS steps FROM a",
    "silent_surfaces": """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS seen FROM events GROUP BY user_id)
  SELECT user_id, array_to_string(list_sort(list_filter(['view', 'click', 'purchase', 'error', 'signup', 'hook'], lambda x: NOT list_contains(seen, x))), ',') AS silent FROM s""",
    "ingest_health": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 AS dropped FROM events)
  SELECT event_type, count(*) FILTER (NOT dropped) AS received, count(*) FILTER (dropped) AS drops, max(ts) FILTER (NOT dropped) AS last_ingest FROM e GROUP BY event_type""",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS runs FROM orders GROUP BY ALL",
    "metric_union": """WITH v AS (SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2)::DOUBLE AS value, bool_or(o_orderkey % 2 = 0) AS stream FROM orders GROUP BY ALL),
  k AS (SELECT o_custkey, bool_or(stream) AS seen FROM v GROUP BY o_custkey), n AS (SELECT DISTINCT o_orderpriority FROM v)
  SELECT k.o_custkey, n.o_orderpriority, coalesce(value, CASE WHEN seen THEN 0.0 END)::DOUBLE AS value FROM k CROSS JOIN n LEFT JOIN v ON v.o_custkey = k.o_custkey AND v.o_orderpriority = n.o_orderpriority""",
    "mixed_conditions": """WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 400 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'one' ELSE c_mktsegment END END AS p FROM customer)
  SELECT c_nationkey, count(DISTINCT p) AS n, count(*) FILTER (p IS NULL) AS unknown FROM r GROUP BY c_nationkey HAVING count(DISTINCT p) <> 1 OR count(*) FILTER (p IS NULL) > 0""",
    "claims": """SELECT 't' || o_custkey AS task, (o_orderkey % 5)::INTEGER AS attempt, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS capture, CASE WHEN count(*) = 1 THEN 'claimed' ELSE 'refused' END AS state
  FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey, o_orderkey % 5""",
    "repetition_order": "SELECT (r * 25 + n_nationkey)::BIGINT AS turn, r::INTEGER AS repetition, n_name FROM nation, (SELECT unnest(range(3)) AS r)",
    "calibration_summary": """WITH r AS (SELECT l_returnflag, l_quantity::DOUBLE AS y, CASE WHEN l_linenumber = 1 THEN 5.0 ELSE 4.0 END AS w FROM lineitem WHERE l_partkey % 30 <> 0),
  q AS (SELECT l_returnflag, k, k / 10.0 AS level, avg((y <= k * w)::INTEGER) AS under, count(*) AS n FROM r, (SELECT unnest(range(1, 10)) AS k) GROUP BY ALL)
  SELECT q.l_returnflag, any_value(q.n) AS n, round(max(abs(under - level)), 6) AS max_deviation, any_value(c) AS coverage80, bool_or(abs(under - level) > 2 * sqrt(level * (1 - level) / q.n)) AS flagged
  FROM q JOIN (SELECT l_returnflag, round(avg((y BETWEEN w AND 9 * w)::INTEGER), 6) AS c FROM r GROUP BY l_returnflag) x ON x.l_returnflag = q.l_returnflag GROUP BY q.l_returnflag""",
    "scenario_faults": f"""WITH p AS (SELECT o_custkey AS scenario, ['tokens', 'ratio', 'y', 'fixed', 'other'][o_orderkey % 5 + 1] AS c, min((o_orderkey // 5) % 5) AS v FROM orders GROUP BY ALL)
  SELECT scenario, c AS "column", unnest(list_filter([CASE WHEN c = 'other' THEN 'unknown_column' END, CASE WHEN c = 'y' THEN 'is_target' END, CASE WHEN c = 'fixed' THEN 'not_declarable' END,
    CASE WHEN v <> 2 OR c = 'tokens' THEN {[f or "" for _, f in PATHS]}[v + 1] END, CASE WHEN scenario % 7 = 0 THEN 'repeated' END], lambda f: f <> '')) AS fault FROM p""",
    "link_ladder": f"""WITH cp AS (SELECT c_custkey AS capture, TIMESTAMP '1995-01-01' + to_days((c_custkey % 1000)::INT) AS s, TIMESTAMP '1995-01-01' + to_days((c_custkey % 1000 + c_custkey % 5 * 200)::INT) AS e FROM customer),
  x AS (SELECT capture, o_orderkey AS k, o_orderdate::TIMESTAMP AS made, s, e, o_orderdate::TIMESTAMP BETWEEN s AND e + INTERVAL {LATE_DAYS} DAY AS inside FROM orders JOIN cp ON capture = o_custkey),
  r AS (SELECT capture, k AS sha, CASE WHEN k % 91 <> 0 AND k % 13 = 0 THEN 0 WHEN k % 91 <> 0 AND k % 11 = 0 THEN 1
    WHEN inside AND (k % 5 = 0 OR k % 5 = 1 AND k % 4 <> 0) THEN CASE WHEN k % 3 = 1 AND made <= e THEN 2 ELSE 3 END WHEN inside THEN 4 END AS rank, true AS known FROM x
    UNION ALL SELECT capture, -k - 1, CASE WHEN k % 13 = 0 THEN 0 ELSE 1 END, false FROM x WHERE k % 91 = 0)
  SELECT capture, sha, ['explicit', 'provider_reported', 'tree_match_during', 'tree_match_after', 'heuristic'][rank + 1] AS rung, known FROM r WHERE rank IS NOT NULL""",
    "regime_state": """WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS regimes FROM orders GROUP BY o_custkey)
  SELECT o_custkey, regimes, CASE WHEN regimes <= 1 THEN 'ok' ELSE 'refused' END AS state FROM g UNION ALL SELECT o_custkey, regimes, CASE WHEN regimes <= 1 THEN 'ok' ELSE 'pooled' END FROM g""",
    "advisory": """WITH r AS (SELECT c_nationkey AS target, arg_max(c_custkey, (c_custkey % 100, c_custkey)) AS run_id FROM customer WHERE c_nationkey % 6 <> 5 GROUP BY c_nationkey),
  j AS (SELECT n_nationkey AS target, n_nationkey % 4 <> 0 AS ready, run_id, CASE WHEN run_id % 2 = 0 THEN 'model_adds' WHEN run_id IS NOT NULL THEN 'baseline_sufficient' END AS label FROM nation LEFT JOIN r ON target = n_nationkey),
  a AS (SELECT *, concat_ws(',', CASE WHEN NOT ready THEN 'not_ready' END, CASE WHEN run_id IS NULL THEN 'no_run' END, CASE WHEN label <> 'model_adds' THEN 'label' END, CASE WHEN run_id % 3 = 0 THEN 'calibration' END) AS against FROM j)
  SELECT *, against = '' AS usable FROM a""",
    "fold_summary": """WITH f AS (SELECT s_nationkey, s_suppkey % 5 AS fold, sum(trunc(s_acctbal * 100)::BIGINT) AS a, sum(trunc(abs(s_acctbal * 100))::BIGINT) AS b FROM supplier GROUP BY ALL),
  g AS (SELECT s_nationkey, 1 - (b::DOUBLE * 0.8::DOUBLE + a * 0.1::DOUBLE) / b::DOUBLE AS gain FROM f WHERE b > 0),
  s AS (SELECT s_nationkey, count(*) AS folds, avg(gain) AS m, count(*) FILTER (gain > 0) AS wins FROM g GROUP BY s_nationkey)
  SELECT s_nationkey, folds, round(m, 6) AS mean_gain, wins, CASE WHEN m >= 0.15 AND wins = folds THEN 'adds' WHEN m >= 0.15 OR wins = folds THEN 'mixed' ELSE 'no_gain' END AS label FROM s""",
    "environment_of_request": "SELECT o_orderkey, s_name AS environment FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 <> 0",
    "first_binding": """WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  f AS (SELECT user_id, min(event_id) FILTER (k % 4 = 0) AS first, max(event_id) FILTER (k % 9 = 0) AS e FROM e GROUP BY user_id)
  SELECT f.user_id, CASE WHEN f.first IS NOT NULL THEN '/r' || (e2.k % 7) END AS cwd, coalesce(f.e > f.first, false) AS ended FROM f LEFT JOIN e e2 ON e2.event_id = f.first""",
    "import_dry_run": """WITH f AS (SELECT 'p' || (o_custkey % 20) AS p, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS t, o_orderkey AS c, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS s FROM orders),
  g AS (SELECT p AS "group", t, s FROM f WHERE t IS NULL OR t::DATE >= DATE '1995-01-01' UNION ALL SELECT coalesce(strftime(t, '%Y-%m-%d'), 'unknown'), t, s FROM f WHERE p = 'p3')
  SELECT "group", count(*) AS files, count(*) FILTER (t IS NOT NULL AND s) AS stored, count(*) FILTER (t IS NOT NULL AND NOT s) AS new, count(*) FILTER (t IS NULL) AS unreadable FROM g GROUP BY "group\"""",
    "replay_order": "SELECT o_orderkey % 2 AS phase, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 100)::DOUBLE END AS at, o_orderpriority AS file, o_orderkey AS line, o_orderstatus AS body FROM orders",
    "passthrough": "SELECT user_id AS capture_id, event_id AS observation_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'tidemark' ELSE 'external' END AS actor, props AS payload FROM events WHERE event_type IN ('error', 'signup')",
    "lifecycle_ordinals": "SELECT user_id, event_id, event_type AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events WHERE event_type IN ('signup', 'purchase')",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
