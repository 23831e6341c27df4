"""The change row over orders as commits, their lines as files, and sessions of the customers behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from .comparisons import LINEAGE, _lineage
from .sessions import SQL as SESSIONS
from .staging import ACTIVITIES_SQL, activities, table


def q_change_rows(spark, d):
    l, k = table(spark, d, "lineitem"), F.col("l_partkey")
    path = F.when(k % 10 == 0, "package.json").when(k % 10 == 1, F.concat(F.lit("tests/t"), k, F.lit(".py"))).otherwise(F.concat(F.lit("src/d"), k % 4, F.lit("/p"), k % 40, F.lit(".py")))
    sums = l.groupBy(F.col("l_orderkey").alias("sha")).agg(F.count("*").alias("files_changed"), F.sum(F.col("l_quantity").cast("long")).alias("lines_added"), F.sum("l_linenumber").cast("long").alias("lines_removed"))
    changes = _lineage(spark, d).select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), F.col("idx").alias("position")).join(sums, "sha", "left")
    o = F.col("o_orderkey")
    links = table(spark, d, "orders").select(o.alias("sha"), F.col("o_custkey").alias("capture_id"), F.when(o % 4 != 0, o % 3 + 1).alias("attempt"))
    status = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "R", "failed").otherwise("maybe")
    outcomes = l.select(
        F.col("l_orderkey").alias("sha"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("outcome_id"), (F.col("l_linenumber") % 2 == 1).alias("verifies"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("duration_ms"), status.alias("status"),
    )
    out = C.change_rows(changes, l.select(F.col("l_orderkey").alias("sha"), path.alias("path")), links, activities(spark, d), outcomes)
    return out.withColumn("edit_turnover_ratio", F.round("edit_turnover_ratio", 6))


SQL = {
    "change_rows": f"""WITH {LINEAGE}, {ACTIVITIES_SQL}, si AS ({SESSIONS['stable_intervals']}),
  li AS (SELECT *, CASE l_partkey % 10 WHEN 0 THEN 'package.json' WHEN 1 THEN 'tests/t' || l_partkey || '.py' ELSE 'src/d' || (l_partkey % 4) || '/p' || (l_partkey % 40) || '.py' END AS path FROM lineitem),
  f AS (SELECT l_orderkey AS sha, count(*) AS files_changed, sum(trunc(l_quantity))::BIGINT AS lines_added, sum(l_linenumber)::BIGINT AS lines_removed, count(DISTINCT string_split(path, '/')[1]) AS subsystems_touched,
    count(DISTINCT path) FILTER (l_partkey % 10 = 1) AS test_files_changed, max((l_partkey % 10 = 0)::INT) AS dependency_delta FROM li GROUP BY 1),
  p AS (SELECT capture_id, CASE WHEN count(*) FILTER (kind = 'model_request' AND fresh IS NULL) = 0 THEN sum(fresh) END::BIGINT AS fresh, CASE WHEN count(*) FILTER (kind = 'model_request' AND cache_read IS NULL) = 0 THEN sum(cache_read) END::BIGINT AS cache_read,
    count(*) FILTER (kind = 'compaction') AS compactions, count(*) FILTER (kind = 'verification_run') AS runs, count(*) FILTER (kind = 'file_edit') / nullif(count(DISTINCT path) FILTER (kind = 'file_edit'), 0)::DOUBLE AS turnover,
    count(*) FILTER (kind = 'repo_snapshot') AS snapshots, CASE WHEN count(*) FILTER (kind = 'file_read') = 0 THEN 0 ELSE nullif(count(DISTINCT path) FILTER (kind = 'file_read'), 0) END AS reads FROM act GROUP BY capture_id),
  v AS (SELECT l_orderkey AS sha, arg_max(struct_pack(d := CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END, s := l_returnflag), (l_linenumber, l_partkey, l_suppkey)) AS x FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
  t AS (SELECT DISTINCT o_custkey AS repo, o_orderkey AS sha, idx, path FROM l JOIN li ON l_orderkey = o_orderkey),
  g AS (SELECT DISTINCT a.sha FROM t a JOIN t b ON a.repo = b.repo AND a.path = b.path AND b.idx BETWEEN a.idx + 1 AND a.idx + 3),
  r AS (SELECT o_custkey AS repo, o_orderkey AS sha, idx AS position, CASE WHEN lead(o_orderkey, 3) OVER w IS NOT NULL THEN CASE WHEN o_orderkey IN (SELECT sha FROM g) THEN 1 ELSE 0 END END AS rework FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY idx))
  SELECT repo, r.sha, position, files_changed, lines_added, lines_removed, subsystems_touched, test_files_changed, dependency_delta, CASE WHEN r.sha % 4 <> 0 THEN r.sha % 3 + 1 END AS attempts_to_land,
    fresh AS fresh_input_tokens_total, cache_read AS cache_read_tokens_total, compactions, runs AS verification_cycles, round(turnover, 6) AS edit_turnover_ratio, CASE WHEN snapshots > 0 THEN coalesce(intervals, 0) END AS stable_state_intervals,
    reads AS unique_files_read, x.d AS merge_verification_ms, CASE x.s WHEN 'N' THEN 0 WHEN 'R' THEN 1 END AS merge_verification_failed, rework AS rework_within_3, lag(rework, 3) OVER (PARTITION BY repo ORDER BY position) AS rework_within_3_lag3
  FROM r LEFT JOIN f ON f.sha = r.sha LEFT JOIN p ON p.capture_id = r.repo LEFT JOIN si ON si.capture_id = r.repo LEFT JOIN v ON v.sha = r.sha""",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
