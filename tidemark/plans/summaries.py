"""Queries over session summaries, capabilities, log observations and snapshot triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import summary as S
from .calls import NAMES, _listed, _pick
from .sessions import SQL as SESSIONS
from .staging import activities, table

BLOCKS = {
    "context": ["compactions", "pre_compaction_tokens", "post_compaction_tokens"], "edits": ["unique_files_changed", "file_revisits", "max_diff_lines"],
    "tests": ["agent_test_runs", "failed_test_runs"], "reads": ["unique_files_read", "directories_traversed"],
}
FLAT = [(b, n) for b, names in BLOCKS.items() for n in names]
REGISTRY = {n: ("tokens" if "tokens" in n else "lines" if "lines" in n else "count", i % 3 == 0) for i, (_, n) in enumerate(FLAT)}
CAPABILITIES = [("view", "paths", "partial"), ("click", "paths", "observed"), ("purchase", "tokens", "derived"), ("error", "tokens", "partial"), ("signup", "commands", "observed"), ("hook", "diffs", "observed")]
KINDS = ("claude.otel.tool_result", "claude.stream.system.vcs_state_changed", "claude.hook.pre", "codex.item")
RUN = ("git commit _", "cat a && git -C x commit -m _", "git status", "git commitx", "echo git commit")


def q_summary_rows(spark, d):
    return S.summary_rows(M.base_metrics(activities(spark, d)), "capture_id", BLOCKS)


def q_summary_json(spark, d):
    return S.summary_json(M.base_metrics(activities(spark, d)), "capture_id", {"context": BLOCKS["context"], "tests": BLOCKS["tests"]})


def q_capability_coverage(spark, d):
    delivered = table(spark, d, "events").select("user_id", "event_type")
    return S.capability_coverage(delivered, "user_id", "event_type", spark.createDataFrame(CAPABILITIES, "surface string, capability string, word string"))


def q_log_observations(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.map_from_arrays(F.array(F.lit("event.name"), F.lit("session.id"), F.lit("size"), F.lit("prompt")), F.array(F.when(k % 5 != 0, F.col("event_type")).otherwise(""), F.concat(F.lit("s"), F.col("user_id")), k.cast("string"), F.lit("hidden"))).alias("attributes"))
    return S.log_observations(rows, "claude", "event.name", "session.id", ["prompt"]).select("event_id", "type", "session", F.to_json("payload").alias("payload"))


def q_snapshot_trigger(spark, d):
    k = F.col("l_partkey")
    word = S.snapshot_trigger(
        F.when(k % 2 == 0, "claude").when(k % 3 == 0, "codex").otherwise("other"), _pick(NAMES, k), _pick(KINDS, F.floor(k / 2)), _pick(RUN, F.floor(k / 3)), F.when(k % 5 == 0, "file_change"), F.when(k % 7 == 0, "started").when(k % 7 == 1, "failed")
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", word.alias("word"))


def q_score_checks(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "true").otherwise(F.concat(F.lit("block-"), F.col("o_orderkey") % 3)).alias("ordering"), F.floor(F.col("o_totalprice") * 100).cast("double").alias("mae"))
    return S.placebo_and_baseline_checks(rows, ["o_custkey"])


def q_target_registry(spark, d):
    """Metrics that the sessions' evidence holds, with their units; those that the registry doesn't name aren't targets."""
    return S.target_registry(M.evidence(M.base_metrics(activities(spark, d))), REGISTRY)


WIDE = SESSIONS["base_metrics"]
SQL = {
    "summary_rows": f"WITH bm AS ({WIDE}) " + " UNION ALL ".join(f"SELECT capture_id, {i} AS position, '{b}' AS block, '{n}' AS metric, {n}::DOUBLE AS value FROM bm" for i, (b, n) in enumerate(FLAT)),
    "summary_json": f"WITH bm AS ({WIDE}) SELECT capture_id, '{{' || "
    + " || ',' || ".join(f"'\"{b}\":{{' || " + " || ',' || ".join(f"'\"{n}\":' || coalesce({n}::VARCHAR, 'null')" for n in BLOCKS[b]) + " || '}'" for b in ("context", "tests"))
    + " || '}' AS summary FROM bm",
    "capability_coverage": "WITH c(surface, capability, word) AS (VALUES " + ", ".join(str(x) for x in CAPABILITIES) + """), dl AS (SELECT DISTINCT user_id, event_type FROM events),
  b AS (SELECT user_id, capability, min(list_position(['observed', 'derived', 'partial', 'unavailable'], word)) AS r FROM dl JOIN c ON surface = event_type GROUP BY ALL)
  SELECT u.user_id, k.capability, ['observed', 'derived', 'partial', 'unavailable'][coalesce(r, 4)] AS coverage FROM (SELECT DISTINCT user_id FROM dl) u CROSS JOIN (SELECT DISTINCT capability FROM c) k
  LEFT JOIN b ON b.user_id = u.user_id AND b.capability = k.capability""",
    "log_observations": """SELECT event_id, 'claude.otel.' || CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'unknown' END AS type, 's' || user_id AS session, '{"size":"' || event_id || '"}' AS payload FROM events""",
    "snapshot_trigger": f"""WITH s AS (SELECT *, {_listed(NAMES)}[l_partkey % {len(NAMES)} + 1] AS tool, {_listed(KINDS)}[(l_partkey // 2) % 4 + 1] AS kind, (l_partkey // 3) % 5 AS run FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN tool IN ('Edit', 'Write') THEN 'file_mutation' WHEN kind LIKE '%vcs_state_changed' THEN 'vcs_state_changed'
    WHEN kind LIKE '%tool_result' AND run IN (0, 1) THEN 'commit_command' END WHEN l_partkey % 3 = 0 THEN CASE WHEN l_partkey % 5 = 0 AND l_partkey % 7 <> 0 THEN 'file_mutation' END END AS word FROM s""",
    "score_checks": """WITH r AS (SELECT o_custkey, o_orderkey % 3 = 0 AS own, floor(o_totalprice * 100)::DOUBLE AS mae FROM orders), g AS (SELECT o_custkey, min(mae) FILTER (own) AS a, quantile_cont(mae, 0.5) FILTER (NOT own) AS t FROM r GROUP BY o_custkey)
  SELECT o_custkey, 'baselines' AS "check", a IS NOT NULL AS passes FROM g UNION ALL SELECT o_custkey, 'placebo', coalesce(a < t, false) FROM g""",
    "target_registry": f"WITH ev AS ({SESSIONS['evidence_long']}), r(target, unit, declarable) AS (VALUES " + ", ".join(f"('{n}', '{u}', {str(m).lower()})" for n, (u, m) in REGISTRY.items())
    + ") SELECT target, unit, declarable, count(value) AS sessions, count(*) - count(value) AS unknown FROM ev JOIN r ON target = metric GROUP BY ALL",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
