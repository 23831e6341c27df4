"""Queries over sessions: scans, facts, the request clock and per-session metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators.nulls import best_coverage, coverage, weakest_coverage
from ..operators.ordered import before, changed, first_rows, last_stated, request_clock, running_max, timeline, upto
from .staging import ACTIVITIES_SQL, activities, table

ACT = "WITH " + ACTIVITIES_SQL


def q_request_clock(spark, d):
    acts = activities(spark, d)
    over = before(M.KEY, M.ORDER)
    return request_clock(
        acts, M.KEY, M.ORDER, M.is_request(),
        {"compactions_since": M.is_compaction(), "tool_calls_since": M.is_tool(), "edits_since": M.is_edit(), "runs_since": M.is_run()},
        {"verification_seen": F.coalesce(F.max(M.is_run().cast("int")).over(over), F.lit(0)), "last_failed": F.coalesce(last_stated((~F.col("success")).cast("int"), over), F.lit(0))},
        ["activity_id", "ts", "fresh", "cache_read", "output"],
    )


def q_captures_view(spark, d):
    e = table(spark, d, "events")
    kind = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.col("user_id").alias("capture_id")).agg(
        F.min_by("event_type", "event_id").alias("provider"), F.min_by(kind, F.when(kind % 10 != 0, F.col("event_id"))).alias("repo"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )


def q_type_scan(spark, d):
    return activities(spark, d).where(M.is_run()).select("capture_id", "activity_id", "ts", "success", "category", "scope")


def q_semi_join_ids(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("activity_id")).where("l_quantity > 45").distinct()
    return activities(spark, d).join(ids, "activity_id", "left_semi").select("capture_id", "activity_id", "kind")


def q_fact_fold(spark, d):
    a = activities(spark, d)
    return a.groupBy("capture_id").agg(
        F.min_by("model", F.when(M.is_request(), F.struct("ts", "activity_id"))).alias("first_model"), F.max_by("model", F.when(M.is_request(), F.struct("ts", "activity_id"))).alias("last_model"),
        F.array_sort(F.collect_set("model")).alias("models"), F.max(F.when(M.is_snapshot(), F.col("additions"))).alias("most_added"), F.bool_or(M.is_run() & F.col("success")).alias("any_pass"),
    ).withColumn("models", F.array_join("models", ","))


def q_latest_per_session(spark, d):
    return first_rows(activities(spark, d), ["capture_id"], [F.col("ts").desc(), F.col("activity_id").desc()]).select("capture_id", "activity_id", "ts", "kind").orderBy(F.col("ts").desc(), "capture_id").limit(50)


def q_base_metrics(spark, d):
    return M.base_metrics(activities(spark, d))


def q_ratio_null(spark, d):
    out = M.ratios(activities(spark, d))
    return out.select("capture_id", F.round("read_to_edit_ratio", 9).alias("read_to_edit_ratio"), F.round("explored_to_final_ratio", 9).alias("explored_to_final_ratio"))


def q_reversions(spark, d):
    return M.reversions(activities(spark, d))


def q_post_failure_window(spark, d):
    return M.post_failure_revisits(activities(spark, d))


def q_fail_to_pass(spark, d):
    return M.fail_to_pass(activities(spark, d))


def q_edits_after_success(spark, d):
    return M.edits_after_success(activities(spark, d))


def q_edit_epochs(spark, d):
    return M.edit_epochs(activities(spark, d))


def q_before_first(spark, d):
    return M.read_before_first_edit(activities(spark, d))


def q_argmax_occupancy(spark, d):
    return M.occupancy(activities(spark, d), 4000).withColumn("occupancy_ratio", F.round("occupancy_ratio", 9))


def q_stable_intervals(spark, d):
    out = M.stable_intervals(activities(spark, d))
    return out.withColumns({"total_ms": F.round("total_ms", 3), "max_ms": F.round("max_ms", 3)})


def _agents(acts):
    """Sub-sessions of the tests: the agents of refused calls, whose parent is the session's next tool call."""
    return acts.where(M.is_tool()).withColumn("parent", F.lead("activity_id").over(timeline(M.KEY, M.ORDER))).where(~F.col("executed")).select("capture_id", "agent", "parent").distinct()


def q_delegated_or_join(spark, d):
    a = activities(spark, d)
    return M.delegated_calls(a, _agents(a))


def q_evidence_long(spark, d):
    return M.evidence(M.base_metrics(activities(spark, d))).select("capture_id", "metric", "value", "evidence_id")


def q_evidence_vector(spark, d):
    long = M.evidence(M.base_metrics(activities(spark, d)))
    names = ["agent_test_runs", "compactions", "failed_test_runs", "fresh_tokens", "model_requests", "unique_files_changed"]
    return long.groupBy("capture_id").pivot("metric", names).agg(F.first("value"))


def q_coverage_words(spark, d):
    a = activities(spark, d)
    words = a.groupBy("capture_id", "model").agg(coverage(M.is_request(), "output").alias("word"))
    return words.groupBy("capture_id").agg(best_coverage(F.col("word")).alias("best"), weakest_coverage(F.col("word")).alias("weakest"))


def q_session_span(spark, d):
    a = activities(spark, d)
    return a.groupBy("capture_id").agg(F.expr("timestampdiff(MICROSECOND, min(ts), max(ts)) / 1000").alias("duration_ms"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("delivered"), F.array_join(F.array_except(F.lit(["compaction", "file_edit", "file_read", "model_request", "repo_snapshot", "tool_call", "verification_run"]), F.collect_set("kind")), ",").alias("silent"))


def q_hash_at_last_run(spark, d):
    from ..operators.ordered import carried

    a = activities(spark, d).withColumn("diff", carried(M.is_snapshot(), F.col("diff_hash"), upto(M.KEY, M.ORDER)))
    return a.where(M.is_run()).groupBy("capture_id").agg(F.max_by(F.struct("diff"), F.struct(*M.ORDER))["diff"].alias("diff_at_last_run"))


def q_env_changed(spark, d):
    a = activities(spark, d).where(M.is_request())
    env = F.when(F.col("k") % 8 != 0, F.col("model"))
    rows = a.select("capture_id", "activity_id", changed(env, M.KEY, M.ORDER).alias("env_changed"), (F.row_number().over(timeline(M.KEY, M.ORDER)) - 1).cast("long").alias("row_index"))
    return rows


def q_running_max(spark, d):
    a = activities(spark, d)
    return a.select("capture_id", "activity_id", running_max(F.col("value"), M.KEY, M.ORDER).alias("peak"))


def q_compaction_episodes(spark, d):
    rows = activities(spark, d).where(M.is_compaction() | M.is_tool()).withColumn("role", F.concat(F.col("kind"), (F.col("k") % 2).cast("string")))
    return M.compaction_episodes(rows, "role")


def q_regimes(spark, d):
    """First rows of constant runs of the model, and the regime in force at every activity (the first one reaches back)."""
    a = activities(spark, d)
    now = last_stated(F.col("model"), upto(M.KEY, M.ORDER))
    ahead = F.first("model", ignorenulls=True).over(timeline(M.KEY, M.ORDER).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = a.withColumn("regime", F.coalesce(now, ahead))
    return rows.select("capture_id", "activity_id", "regime", (~F.col("regime").eqNullSafe(F.lag("regime").over(timeline(M.KEY, M.ORDER)))).alias("opens"))


W = "WINDOW o AS (PARTITION BY capture_id ORDER BY ts, activity_id)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "compaction_episodes": "WITH RECURSIVE " + ACTIVITIES_SQL + """, r AS (SELECT capture_id, activity_id, kind || (k % 2) AS role, row_number() OVER (PARTITION BY capture_id ORDER BY ts, activity_id) AS n
  FROM act WHERE kind IN ('compaction', 'tool_call')),
  w AS (SELECT capture_id, n, activity_id, 1 AS episode, [role] AS open FROM r WHERE n = 1
    UNION ALL SELECT r.capture_id, r.n, r.activity_id, w.episode + list_contains(w.open, r.role)::INTEGER, CASE WHEN list_contains(w.open, r.role) THEN [r.role] ELSE list_append(w.open, r.role) END
    FROM w JOIN r ON r.capture_id = w.capture_id AND r.n = w.n + 1) SELECT capture_id, activity_id, episode FROM w""",
    "request_clock": ACT + """, s AS (SELECT *, coalesce(sum((kind = 'model_request')::INT) OVER p, 0)::BIGINT AS segment,
      coalesce(max((kind = 'verification_run')::INT) OVER p, 0) AS seen, coalesce(last_value((NOT success)::INT IGNORE NULLS) OVER p, 0) AS failed FROM act
      WINDOW p AS (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      g AS (SELECT capture_id, segment, count(*) FILTER (kind = 'compaction') AS compactions_since, count(*) FILTER (kind = 'tool_call') AS tool_calls_since,
        count(*) FILTER (kind = 'file_edit') AS edits_since, count(*) FILTER (kind = 'verification_run') AS runs_since FROM s GROUP BY ALL)
      SELECT s.capture_id, segment, activity_id, ts, fresh, cache_read, output, compactions_since, tool_calls_since, edits_since, runs_since, seen AS verification_seen, failed AS last_failed
      FROM s JOIN g USING (capture_id, segment) WHERE kind = 'model_request'""",
    "captures_view": """SELECT user_id AS capture_id, arg_min(event_type, event_id) AS provider, arg_min(k, event_id) FILTER (k % 10 <> 0) AS repo, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id""",
    "type_scan": ACT + " SELECT capture_id, activity_id, ts, success, category, scope FROM act WHERE kind = 'verification_run'",
    "semi_join_ids": ACT + " SELECT capture_id, activity_id, kind FROM act WHERE activity_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "fact_fold": ACT + """ SELECT capture_id, arg_min(model, (ts, activity_id)) FILTER (kind = 'model_request') AS first_model, arg_max(model, (ts, activity_id)) FILTER (kind = 'model_request') AS last_model,
      coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, max(additions) AS most_added, bool_or(kind = 'verification_run' AND success) AS any_pass FROM act GROUP BY capture_id""",
    "latest_per_session": ACT + " SELECT capture_id, activity_id, ts, kind FROM act QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ts DESC, activity_id DESC) = 1 ORDER BY ts DESC, capture_id LIMIT 50",
    "base_metrics": ACT + """ SELECT capture_id, count(*) FILTER (kind = 'model_request') AS model_requests, sum(fresh)::BIGINT AS fresh_tokens, sum(cache_read)::BIGINT AS cache_read_tokens,
      sum(cache_creation)::BIGINT AS cache_creation_tokens, sum(output)::BIGINT AS output_tokens,
      CASE WHEN count(output) = 0 THEN 'unavailable' WHEN count(output) < count(*) FILTER (kind = 'model_request') THEN 'partial' ELSE 'observed' END AS output_coverage,
      CASE WHEN count(cache_read) = 0 THEN 'unavailable' WHEN count(cache_read) < count(*) FILTER (kind = 'model_request') THEN 'partial' ELSE 'observed' END AS cache_read_coverage,
      CASE WHEN count(*) FILTER (kind = 'file_edit') = 0 THEN 0 ELSE nullif(count(DISTINCT path) FILTER (kind = 'file_edit'), 0) END AS unique_files_changed,
      CASE WHEN count(*) FILTER (kind = 'file_edit') = 0 THEN 0 WHEN count(path) FILTER (kind = 'file_edit') > 0 THEN count(path) FILTER (kind = 'file_edit') - count(DISTINCT path) FILTER (kind = 'file_edit') END AS file_revisits,
      max(additions + coalesce(deletions, 0)) AS max_diff_lines, arg_max(additions + coalesce(deletions, 0), (ts, activity_id)) FILTER (kind = 'repo_snapshot') AS final_diff_lines,
      count(*) FILTER (kind = 'tool_call' AND NOT executed) AS refused_tool_calls, count(*) FILTER (category = 'test') AS agent_test_runs,
      CASE WHEN count(*) FILTER (category = 'test' AND success IS NULL) = 0 THEN count(*) FILTER (category = 'test' AND NOT success) END AS failed_test_runs,
      count(*) FILTER (category = 'test' AND scope = 'targeted') AS targeted_test_runs, count(*) FILTER (category = 'test' AND scope = 'full') AS full_test_runs,
      CASE WHEN count(*) FILTER (kind = 'file_read') = 0 THEN 0 ELSE nullif(count(DISTINCT path) FILTER (kind = 'file_read'), 0) END AS unique_files_read,
      count(*) FILTER (kind = 'compaction') AS compactions, sum(pre_tokens)::BIGINT AS pre_compaction_tokens, sum(post_tokens)::BIGINT AS post_compaction_tokens,
      CASE WHEN count(*) FILTER (kind = 'file_read') = 0 THEN 0 ELSE nullif(count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '.' END) FILTER (kind = 'file_read'), 0) END AS directories_traversed
      FROM act GROUP BY capture_id""",
    "ratio_null": ACT + """, m AS (SELECT capture_id, CASE WHEN count(*) FILTER (kind = 'file_read') = 0 THEN 0 ELSE nullif(count(DISTINCT path) FILTER (kind = 'file_read'), 0) END AS r,
      nullif(count(DISTINCT path) FILTER (kind = 'file_edit'), 0) AS e, CASE WHEN count(*) FILTER (kind = 'file_read') = 0 THEN 0 ELSE nullif(count(DISTINCT dir) FILTER (kind = 'file_read'), 0) END AS rd, nullif(count(DISTINCT dir) FILTER (kind = 'file_edit'), 0) AS ed
      FROM (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '.' END AS dir FROM act) GROUP BY capture_id)
      SELECT capture_id, round(r::DOUBLE / e, 9) AS read_to_edit_ratio, round(rd::DOUBLE / ed, 9) AS explored_to_final_ratio FROM m""",
    "reversions": ACT + """ SELECT capture_id, count(*) FILTER (back) AS reversions FROM (SELECT capture_id, diff_hash <> lag(diff_hash) OVER o AND row_number() OVER (PARTITION BY capture_id, diff_hash ORDER BY ts, activity_id) > 1 AS back
      FROM act WHERE kind = 'repo_snapshot' AND diff_hash IS NOT NULL """ + W + ") GROUP BY capture_id",
    "post_failure_window": ACT + """, r AS (SELECT *, count(*) FILTER (NOT success) OVER o AS f, row_number() OVER (PARTITION BY capture_id, kind, path ORDER BY ts, activity_id) > 1 AS again FROM act WHERE kind IN ('file_edit', 'verification_run') """ + W + """),
      n AS (SELECT *, count(*) FILTER (kind = 'file_edit') OVER (PARTITION BY capture_id, f ORDER BY ts, activity_id) AS nth FROM r)
      SELECT capture_id, CASE WHEN count(*) FILTER (kind = 'verification_run' AND success IS NULL) = 0 THEN count(*) FILTER (kind = 'file_edit' AND f > 0 AND nth <= 3 AND path IS NOT NULL AND again) END AS post_failure_revisits FROM n GROUP BY capture_id""",
    "fail_to_pass": ACT + """ SELECT capture_id, CASE WHEN bool_and(success IS NOT NULL) THEN count(*) FILTER (success AND NOT was) END AS fail_to_pass_cycles
      FROM (SELECT *, lag(success) OVER (PARTITION BY capture_id, category ORDER BY ts, activity_id) AS was FROM act WHERE kind = 'verification_run') GROUP BY capture_id""",
    "edits_after_success": ACT + """, r AS (SELECT * FROM act WHERE kind IN ('file_edit', 'verification_run')), l AS (SELECT capture_id, max((ts, activity_id)) FILTER (success) AS p FROM r GROUP BY capture_id)
      SELECT capture_id, CASE WHEN count(*) FILTER (kind = 'verification_run' AND success IS NULL AND (p IS NULL OR (ts, activity_id) > p)) = 0 THEN count(*) FILTER (kind = 'file_edit' AND (ts, activity_id) > p) END AS edits_after_last_success
      FROM r JOIN l USING (capture_id) GROUP BY capture_id""",
    "edit_epochs": ACT + """ SELECT capture_id, count(*) FILTER (kind = 'verification_run' AND was = 'file_edit') AS epochs_with_verification, (arg_max(kind, (ts, activity_id)) = 'file_edit')::BIGINT AS epochs_without_verification
      FROM (SELECT *, lag(kind) OVER o AS was FROM act WHERE kind IN ('file_edit', 'verification_run') """ + W + ") GROUP BY capture_id",
    "before_first": ACT + """, f AS (SELECT capture_id, min((ts, activity_id)) AS first FROM act WHERE kind = 'file_edit' GROUP BY capture_id)
      SELECT capture_id, CASE WHEN count(*) FILTER (early) = 0 THEN 0 ELSE nullif(count(DISTINCT path) FILTER (early), 0) END AS read_before_first_edit
      FROM (SELECT a.*, kind = 'file_read' AND (ts, activity_id) < first AS early FROM act a JOIN f USING (capture_id)) GROUP BY capture_id""",
    "argmax_occupancy": ACT + """ SELECT capture_id, round(max(used) / 4000.0::DOUBLE, 9) AS occupancy_ratio, arg_max(activity_id, (used, -activity_id)) AS source_activity
      FROM (SELECT *, coalesce(fresh, 0) + coalesce(cache_read, 0) + coalesce(cache_creation, 0) AS used FROM act WHERE kind = 'model_request') GROUP BY capture_id""",
    "stable_intervals": ACT + """, s AS (SELECT *, count(*) FILTER (kind = 'repo_snapshot') OVER o AS sn FROM act """ + W + """),
      s2 AS (SELECT *, first_value(CASE WHEN kind = 'repo_snapshot' THEN diff_hash END) OVER (PARTITION BY capture_id, sn ORDER BY ts, activity_id) AS diff FROM s),
      v AS (SELECT *, count(*) FILTER (kind = 'verification_run') OVER o AS vn FROM s2 """ + W + """),
      v2 AS (SELECT *, CASE WHEN vn > 0 THEN first_value(category || '/' || coalesce(success::VARCHAR, '?') || '/' || coalesce(diff, '?')) OVER (PARTITION BY capture_id, vn ORDER BY ts, activity_id) END AS chk FROM v),
      w AS (SELECT *, (lag(activity_id) OVER o IS NOT NULL) AND (diff IS DISTINCT FROM lag(diff) OVER o OR chk IS DISTINCT FROM lag(chk) OVER o) AS change FROM v2 WHERE kind IN ('model_request', 'tool_call', 'file_read', 'file_edit') """ + W + """),
      i AS (SELECT *, sum(change::INT) OVER o AS island FROM w """ + W + """),
      e AS (SELECT capture_id, island, any_value(coalesce(diff, '?')) AS diff, CASE WHEN count(*) FILTER (kind = 'model_request' AND fresh + cache_read + cache_creation + output IS NULL) = 0 THEN sum(fresh + cache_read + cache_creation + output) END AS tokens,
        CASE WHEN count(*) > 1 THEN epoch_us(max(ts)) - epoch_us(min(ts)) END AS span FROM i GROUP BY ALL),
      x AS (SELECT *, lead(diff) OVER (PARTITION BY capture_id ORDER BY island) AS nxt FROM e)
      SELECT capture_id, count(*) AS intervals, round(sum(span) / 1000.0::DOUBLE, 3) AS total_ms, round(max(span) / 1000.0::DOUBLE, 3) AS max_ms, sum(tokens)::BIGINT AS tokens,
        count(*) FILTER (nxt <> diff) AS ended_by_edit, count(*) FILTER (nxt = diff) AS ended_by_verification, count(*) FILTER (nxt IS NULL) AS ended_by_end FROM x GROUP BY capture_id""",
    "delegated_or_join": ACT + """, t AS (SELECT *, lead(activity_id) OVER o AS parent FROM act WHERE kind = 'tool_call' """ + W + """), g AS (SELECT DISTINCT capture_id, agent, parent FROM t WHERE NOT executed),
      n AS (SELECT capture_id, activity_id FROM t WHERE EXISTS (SELECT 1 FROM g WHERE g.capture_id = t.capture_id AND (g.agent = t.agent OR g.parent = t.activity_id)))
      SELECT capture_id, coalesce((SELECT count(*) FROM g WHERE g.capture_id = t.capture_id), 0) AS subagent_count, (SELECT count(*) FROM n WHERE n.capture_id = t.capture_id) AS delegated_tool_calls,
        count(*) - (SELECT count(*) FROM n WHERE n.capture_id = t.capture_id) AS direct_tool_calls FROM t GROUP BY capture_id""",
    "coverage_words": ACT + """, w AS (SELECT capture_id, model, CASE WHEN count(output) = 0 THEN 'unavailable' WHEN count(output) < count(*) FILTER (kind = 'model_request') THEN 'partial' ELSE 'observed' END AS word FROM act GROUP BY ALL)
      SELECT capture_id, CASE min(CASE word WHEN 'observed' THEN 1 WHEN 'partial' THEN 2 ELSE 4 END) WHEN 1 THEN 'observed' WHEN 2 THEN 'partial' ELSE 'unavailable' END AS best,
        CASE max(CASE word WHEN 'observed' THEN 1 WHEN 'partial' THEN 3 ELSE 4 END) WHEN 1 THEN 'observed' WHEN 3 THEN 'partial' ELSE 'unavailable' END AS weakest FROM w GROUP BY capture_id""",
    "session_span": ACT + """ SELECT capture_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE AS duration_ms, string_agg(DISTINCT kind, ',' ORDER BY kind) AS delivered,
      array_to_string(list_filter(['compaction', 'file_edit', 'file_read', 'model_request', 'repo_snapshot', 'tool_call', 'verification_run'], lambda x: NOT list_contains(list(DISTINCT kind), x)), ',') AS silent FROM act GROUP BY capture_id""",
    "hash_at_last_run": ACT + """, s AS (SELECT *, count(*) FILTER (kind = 'repo_snapshot') OVER o AS sn FROM act """ + W + """), s2 AS (SELECT *, first_value(CASE WHEN kind = 'repo_snapshot' THEN diff_hash END) OVER (PARTITION BY capture_id, sn ORDER BY ts, activity_id) AS diff FROM s)
      SELECT capture_id, diff AS diff_at_last_run FROM s2 WHERE kind = 'verification_run' QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ts DESC, activity_id DESC) = 1""",
    "env_changed": ACT + """ SELECT capture_id, activity_id, CASE WHEN env IS NOT NULL THEN CASE WHEN was IS NULL OR was = env THEN 0 ELSE 1 END END AS env_changed, rn - 1 AS row_index
      FROM (SELECT *, lag(env) OVER o AS was, row_number() OVER o AS rn FROM (SELECT *, CASE WHEN k % 8 <> 0 THEN model END AS env FROM act WHERE kind = 'model_request') """ + W + ")",
    "running_max": ACT + " SELECT capture_id, activity_id, max(value) OVER o AS peak FROM act " + W,
    "regimes": ACT + """, r AS (SELECT capture_id, activity_id, ts, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(model IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS regime FROM act)
      SELECT capture_id, activity_id, regime, regime IS DISTINCT FROM lag(regime) OVER o AS opens FROM r """ + W,
}
SQL["evidence_vector"] = "SELECT capture_id, agent_test_runs::DOUBLE AS agent_test_runs, compactions::DOUBLE AS compactions, failed_test_runs::DOUBLE AS failed_test_runs, fresh_tokens::DOUBLE AS fresh_tokens, model_requests::DOUBLE AS model_requests, unique_files_changed::DOUBLE AS unique_files_changed FROM (" + SQL["base_metrics"] + ")"
_METRICS = ("model_requests", "fresh_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "unique_files_changed", "file_revisits", "max_diff_lines", "final_diff_lines", "refused_tool_calls",
            "agent_test_runs", "failed_test_runs", "targeted_test_runs", "full_test_runs", "unique_files_read", "compactions", "pre_compaction_tokens", "post_compaction_tokens", "directories_traversed")
SQL["evidence_long"] = (
    "SELECT capture_id, metric, value, 'ev_' || substr(sha256(capture_id::VARCHAR || '|' || metric), 1, 24) AS evidence_id FROM (SELECT capture_id, "
    + ", ".join(f"{c}::DOUBLE AS {c}" for c in _METRICS) + " FROM (" + SQL["base_metrics"] + ")) UNPIVOT INCLUDE NULLS (value FOR metric IN (" + ", ".join(_METRICS) + "))"
)
