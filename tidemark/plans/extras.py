"""Queries over surfaces, attribution, lineage outcomes and the rest of the forecast lab."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import forecast as L
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import resolve as R
from ..operators.ordered import first_rows, timeline
from ..sources import store as T
from ..sources import surfaces as V
from .comparisons import LINEAGE, _lineage
from .forecasts import _true
from .series import REGIMES
from .staging import ACTIVITIES_SQL, activities, table

ACT = "WITH " + ACTIVITIES_SQL


def q_hook_surface(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.initcap("event_type").alias("hook_event_name"), F.when(F.col("event_id") % 3 == 0, F.lit("Read")).alias("tool_name")))
    out = V.hooks(e.select(F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(body).alias("value")))
    return out.groupBy("session", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("payload")["tool"] == "Read").alias("reads"))


def q_exec_surface(spark, d):
    o = table(spark, d, "orders")
    usage = F.struct(F.col("o_orderkey").alias("input_tokens"), (F.col("o_orderkey") % 100).alias("cached_input_tokens"), F.lit(7).alias("output_tokens"))
    item = F.struct(F.concat(F.lit("i"), F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("reasoning")).otherwise("command_execution").alias("type"), (F.col("o_orderkey") % 2).cast("int").alias("exit_code"))
    done = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.col("o_custkey").cast("string").alias("thread_id"), item.alias("item")))
    turn = F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.col("o_custkey").cast("string").alias("thread_id"), usage.alias("usage")))
    out = V.exec_lines(o.select(F.explode(F.array(done, turn)).alias("value")))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("payload")["exit_code"].cast("long")).alias("failed"), F.sum(F.col("payload")["fresh"].cast("long")).alias("fresh"))


def q_rollout_surface(spark, d):
    o = table(spark, d, "orders")
    body = F.to_json(F.struct(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:02:03Z")).alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(F.col("o_orderkey").alias("input_tokens")).alias("last_token_usage")).alias("info")).alias("payload")))
    out = V.rollout_lines(o.select("o_custkey", body.alias("value")), "o_custkey")
    return out.groupBy("session").agg(F.first("kind").alias("kind"), F.min("at").alias("first"), F.sum(F.col("payload")["input"].cast("long")).alias("input"))


def q_session_totals(spark, d):
    o = table(spark, d, "orders")
    body = F.format_string('{"type":"result","session_id":"%d","modelUsage":{"m%d":{"contextWindow":%d,"outputTokens":%d},"z":{"contextWindow":10,"outputTokens":1}}}', F.col("o_custkey"), F.col("o_orderkey") % 3, F.col("o_orderkey") % 1000, F.col("o_orderkey"))
    return V.session_totals(o.select(body.alias("value")))


def q_key_set_shape(spark, d):
    p = table(spark, d, "part")
    full = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"), F.lit("c"), F.col("p_brand"))
    payload = F.map_filter(full, lambda k, v: ~((F.col("p_partkey") % 3 == 0) & (k == "c")) & ~((F.col("p_partkey") % 7 == 0) & (k == "a")))
    return V.by_key_set(p.select("p_partkey", payload.alias("payload")), "payload", {"wide": ("a", "b", "c"), "narrow": ("b", "a")}).select("p_partkey", "shape")


def q_denial_lookup(spark, d):
    """Refused calls told directly or in a list of ids; the first telling wins."""
    a = activities(spark, d).where(M.is_tool())
    listed = a.where("k % 4 = 2 and k % 8 = 2").groupBy("capture_id").agg(F.collect_list("activity_id").alias("ids")).select(F.explode("ids").alias("activity_id"))
    return R.first_telling(a, "activity_id", [("direct", a.where(~F.col("executed"))), ("list", listed)], "denied_by").select("capture_id", "activity_id", "denied_by")


def q_attribution(spark, d):
    """A session of a row: stated, else learned from an earlier row of its model, else a default."""
    a = activities(spark, d).where(M.is_request())
    stated = F.when(F.col("k") % 4 == 0, F.col("capture_id"))
    return R.attributed(a, stated, ["model", "capture_id"], ["ts", "activity_id"], F.concat(F.lit("derived-"), F.col("model"))).select("activity_id", "session")


def q_identity_refusal(spark, d):
    """The one segment and priority of a customer's open orders; two different ones are refused."""
    return R.sole_identity(table(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")


def q_arms_full_outer(spark, d):
    """Per part type, the counts of two arms; a type that one arm lacks stays."""
    arm = F.when(F.col("p_size") < 10, "a").when(F.col("p_size") >= 40, "b")
    return R.arms_side_by_side(table(spark, d, "part"), ["p_type", "p_brand"], arm, {"a": "n_a", "b": "n_b"})


def q_version_resolution(spark, d):
    """probe, else session, else record, and which it was."""
    stated = {word: F.when(F.col("p_partkey") % m == 0, F.concat(F.lit(word[0]), F.col("p_size"))) for word, m in (("probe", 5), ("session", 3), ("record", 2))}
    version, source = R.first_known(stated)
    return table(spark, d, "part").select("p_partkey", version.alias("version"), source.alias("source"))


def q_newest_run(spark, d):
    return R.newest(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")


def q_change_clock(spark, d):
    """One row per order of a customer: churn, distinct parts, the last outcome known three orders later, and its reason."""
    rows = _lineage(spark, d)
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("churn"), F.countDistinct("l_partkey").alias("parts"), F.max_by("l_returnflag", F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")).alias("outcome"))
    w = timeline(["o_custkey"], ["idx"])
    j = rows.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    decided = F.lead("o_orderdate", 3).over(w).isNotNull()
    passed = F.when(F.col("outcome") == "N", 1).when(F.col("outcome") == "R", 0)
    reason = F.when(~decided, "not decided yet").when(F.col("outcome").isNull(), "no outcome").when(passed.isNull(), "unread status")
    return j.select("o_custkey", "idx", "churn", F.coalesce("parts", F.lit(0)).alias("parts"), F.when(decided, passed).alias("passed"), reason.alias("reason"), F.lag(F.when(decided, passed), 3).over(w).alias("label"))


def q_crossed_bound(spark, d):
    """Running known totals of a session against a bound: the first request that crosses it; null if a counter is missing before."""
    return R.first_crossing(activities(spark, d).where(M.is_request()), M.KEY, M.ORDER, F.col("fresh") + F.col("cache_creation"), 300, "activity_id")


def q_unknown_fields(spark, d):
    """Per session, how often each field outside the allowlist came."""
    e = table(spark, d, "events").withColumn("payload", F.map_from_arrays(F.array("event_type", F.lit("k")), F.array(F.lit("1"), F.lit("2"))))
    return e.select("user_id", F.explode(S.dropped_keys(F.col("payload"), ["k", "view", "click"])).alias("field")).groupBy("user_id", "field").agg(F.count("*").alias("n"))


def q_stale_versions(spark, d):
    p = table(spark, d, "part").withColumn("version", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")))
    return T.stale(p, "version", ["Brand#1", "Brand#2"]).select("p_partkey", "version")


def q_retention_purge(spark, d):
    return T.older_than(table(spark, d, "events"), "ts", "2024-01-31 00:00:00", 10).select("event_id", "ts")


def q_todo_set(spark, d):
    """New orders of a customer (those above a mark) and the last three of the others."""
    return R.todo(_lineage(spark, d), F.col("o_orderkey") % 9 == 0, ["o_custkey"], "idx").select("o_custkey", "o_orderkey")


def q_probe_scoring(spark, d):
    """Words of each answer that name a wanted nation (by number), with precision and recall."""
    answer = F.concat(F.lit("NATION_"), F.col("c_nationkey"), F.lit(", NATION_"), (F.col("c_nationkey") + F.col("c_custkey") % 3) % 25, F.lit(" and nation"))
    answers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("want"), answer.alias("answer"))
    g = R.probe_scores(answers, ["c_custkey"], "answer", "want", table(spark, d, "nation"), "n_name", "n_nationkey")
    return g.select("c_custkey", F.round("precision", 6).alias("precision"), F.round(F.col("hits") / 1.0, 6).alias("recall"))


def q_one_step_forecast(spark, d):
    """Every baseline's next value behind the last row."""
    s = _true(spark, d)
    last = s.groupBy("series_id", "ordering").agg(F.max("row_index").alias("m"))
    ahead = last.select("series_id", "ordering", (F.col("m") + 1).alias("row_index"), F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("regime_start"), F.lit(False).alias("changepoint"))
    f = L.forecasts(s.unionByName(ahead), 1).join(ahead.select("series_id", F.col("row_index").alias("origin")), ["series_id", "origin"])
    return f.select("series_id", "origin", *(F.round(F.col(b)[0], 6).alias(b) for b in L.BASELINES))


def q_scenario_compare(spark, d):
    """Two declared paths for the next four rows, each scaled by the last value: their difference by step."""
    s = first_rows(_true(spark, d).where("y is not null"), ["series_id"], [F.col("row_index").desc()]).select("series_id", "y")
    path = lambda name, values: s.select("series_id", F.posexplode(F.transform(F.lit(values), lambda v: v * F.col("y"))).alias("step", name))
    return path("a", [1.0, 1.0, 1.0, 1.0]).join(path("b", [1.0, 1.1, 1.2, 1.3]), ["series_id", "step"]).select("series_id", "step", F.round(F.col("b") - F.col("a"), 4).alias("difference"))


def q_or_join(spark, d):
    """OR-joined pairs of parts and suppliers by number or by size and nation."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("num"), F.col("p_size").cast("long").alias("size"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("num2"), F.col("s_nationkey").cast("long").alias("size2"))
    return J.any_key_match(p, s, [("num", "num2"), ("size", "size2")], ["p_partkey"], ["s_suppkey"])


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "hook_surface": "SELECT user_id::VARCHAR AS session, 'hook.' || event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS reads FROM events WHERE event_id % 10 <> 9 GROUP BY ALL",
    "exec_surface": "SELECT 'exec.item.completed.command_execution' AS kind, count(*) AS n, sum(o_orderkey % 2)::BIGINT AS failed, NULL::BIGINT AS fresh FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'exec.turn.completed', count(*), NULL, sum(o_orderkey - o_orderkey % 100)::BIGINT FROM orders",
    "rollout_surface": "SELECT o_custkey AS session, 'rollout.event_msg.token_count' AS kind, min(date_trunc('day', o_orderdate) + INTERVAL 3723 SECOND) AS first, sum(o_orderkey)::BIGINT AS input FROM orders GROUP BY 1",
    "session_totals": "SELECT o_custkey::VARCHAR AS session, greatest(max(o_orderkey % 1000), 10) AS context_window, string_agg(DISTINCT 'm' || (o_orderkey % 3), ',' ORDER BY 'm' || (o_orderkey % 3)) || ',z' AS models, max(o_orderkey) + 1 AS output FROM orders GROUP BY o_custkey",
    "key_set_shape": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'narrow' ELSE 'wide' END AS shape FROM part",
    "denial_lookup": ACT + " SELECT capture_id, activity_id, CASE WHEN NOT executed THEN 'direct' WHEN k % 8 = 2 THEN 'list' END AS denied_by FROM act WHERE kind = 'tool_call'",
    "attribution": ACT + ", s AS (SELECT *, CASE WHEN k % 4 = 0 THEN capture_id END AS stated FROM act WHERE kind = 'model_request') SELECT activity_id, coalesce(stated::VARCHAR, (last_value(stated IGNORE NULLS) OVER (PARTITION BY model, capture_id ORDER BY ts, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::VARCHAR, 'derived-' || model) AS session FROM s",
    "identity_refusal": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS identity, count(DISTINCT o_orderpriority)::INTEGER AS claims FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "arms_full_outer": "SELECT * FROM (SELECT p_type, p_brand, count(*) AS n_a FROM part WHERE p_size < 10 GROUP BY ALL) FULL JOIN (SELECT p_type, p_brand, count(*) AS n_b FROM part WHERE p_size >= 40 GROUP BY ALL) USING (p_type, p_brand)",
    "version_resolution": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'p' || p_size WHEN p_partkey % 3 = 0 THEN 's' || p_size WHEN p_partkey % 2 = 0 THEN 'r' || p_size END AS version, CASE WHEN p_partkey % 5 = 0 THEN 'probe' WHEN p_partkey % 3 = 0 THEN 'session' WHEN p_partkey % 2 = 0 THEN 'record' END AS source FROM part",
    "newest_run": "SELECT o_custkey, o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY ALL",
    "change_clock": f"""WITH {LINEAGE}, i AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS churn, count(DISTINCT l_partkey) AS parts, arg_max(l_returnflag, (l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity)) AS outcome FROM lineitem GROUP BY 1),
      j AS (SELECT *, lead(o_orderdate, 3) OVER w IS NOT NULL AS decided, CASE outcome WHEN 'N' THEN 1 WHEN 'R' THEN 0 END AS p FROM l LEFT JOIN i ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY idx))
      SELECT o_custkey, idx, churn, coalesce(parts, 0) AS parts, CASE WHEN decided THEN p END AS passed, CASE WHEN NOT decided THEN 'not decided yet' WHEN outcome IS NULL THEN 'no outcome' WHEN p IS NULL THEN 'unread status' END AS reason, lag(CASE WHEN decided THEN p END, 3) OVER (PARTITION BY o_custkey ORDER BY idx) AS label FROM j""",
    "crossed_bound": ACT + """, r AS (SELECT *, sum(fresh + cache_creation) OVER o AS s, count(*) FILTER (fresh + cache_creation IS NULL) OVER o AS holes FROM act WHERE kind = 'model_request' WINDOW o AS (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT capture_id, CASE WHEN arg_min(holes, (ts, activity_id)) = 0 THEN arg_min(activity_id, (ts, activity_id)) END AS crossed_at, arg_min(holes, (ts, activity_id)) AS holes FROM r WHERE s > 300 GROUP BY 1""",
    "unknown_fields": "SELECT user_id, event_type AS field, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY ALL",
    "stale_versions": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS version FROM part WHERE CASE WHEN p_partkey % 4 <> 0 THEN p_brand END NOT IN ('Brand#1', 'Brand#2')",
    "retention_purge": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'",
    "todo_set": f"WITH {LINEAGE} SELECT o_custkey, o_orderkey FROM l WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY idx DESC) AS n FROM l WHERE o_orderkey % 9 <> 0) WHERE n <= 3",
    "probe_scoring": "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.5 END, 6)::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM customer",
    "one_step_forecast": "WITH " + REGIMES + ", n AS (SELECT *, max(row_index) OVER (PARTITION BY series_id) - row_index AS back FROM r) SELECT series_id, max(row_index) + 1 AS origin, round(max(y) FILTER (back = 0) + (max(y) FILTER (back = 0) - max(y) FILTER (back = 8)) / 8, 6) AS local_drift, round(max(y) FILTER (back = 0), 6) AS persistence, round(avg(y) FILTER (back < 8), 6) AS rolling_mean, round(median(y) FILTER (back < 8), 6) AS rolling_median FROM n GROUP BY 1",
    "scenario_compare": "WITH " + REGIMES + ", l AS (SELECT series_id, arg_max(y, row_index) FILTER (y IS NOT NULL) AS y FROM r GROUP BY 1) SELECT series_id, step, round((b - 1) * y, 4) AS difference FROM l CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 1.1::DOUBLE), (2, 1.2::DOUBLE), (3, 1.3::DOUBLE)) p(step, b)",
    "or_join": "SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey = s_suppkey OR p_size = s_nationkey",
}
