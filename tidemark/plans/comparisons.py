"""Queries over joins of several sources, cohorts, and two-arm statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import compare as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import resolve as R
from ..operators.ordered import timeline
from .staging import ACTIVITIES_SQL, activities, table

ACT = "WITH " + ACTIVITIES_SQL


def _surfaces(spark, d):
    """Two descriptions of an order: what the order states, and what its lines add up to (in cents)."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit("stated").alias("surface"), F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") * 100)).cast("long").alias("cents"), F.lit(None).cast("long").alias("lines"), F.col("o_orderstatus").alias("status"))
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("lines"), F.max("l_linestatus").alias("status"))
    return o, l.select("o_orderkey", F.lit("lines").alias("surface"), "cents", "lines", "status")


def q_surface_coalesce(spark, d):
    """Each field from the best-ranked surface that states it."""
    o, l = _surfaces(spark, d)
    both = o.unionByName(l).withColumn("r", F.when(F.col("surface") == "stated", 0).otherwise(1))
    field = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("r")))
    return both.groupBy("o_orderkey").agg(*(field(c).alias(c) for c in ("cents", "lines", "status")), F.min_by("surface", F.when(F.col("cents").isNotNull(), F.col("r"))).alias("cents_from"))


def q_stream_only_union(spark, d):
    """Orders, and lines whose order isn't there: an anti-join and a union."""
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 3").select("o_orderkey", F.lit("primary").alias("origin"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return o.unionByName(l.join(o, "o_orderkey", "left_anti").select("o_orderkey", F.lit("lines").alias("origin")))


def q_surface_conflicts(spark, d):
    o, l = _surfaces(spark, d)
    j = o.select("o_orderkey", F.col("cents").alias("stated"), F.col("status").alias("stated_status")).join(l, "o_orderkey")
    return j.where(F.col("stated") != F.col("cents")).select("o_orderkey", "stated", "cents", (F.col("stated_status") != F.col("status")).alias("status_differs"))


def q_unique_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    s = table(spark, d, "part").where("p_partkey % 9 = 0").select("p_brand", "p_size", F.col("p_partkey").alias("only_part"))
    return J.unique_match(p, s, ["p_brand", "p_size"])


def _tokens(spark, d):
    a = activities(spark, d)
    left = a.where(M.is_compaction()).select("capture_id", "post_tokens", F.col("activity_id").alias("left_id"))
    right = a.where(M.is_compaction() & (F.col("k") % 2 == 1)).select("capture_id", F.when(F.col("k") % 3 != 0, (F.col("k") - 2) * 10).cast("long").alias("post_tokens"), F.col("activity_id").alias("right_id"))
    return left, right


def q_value_match_one_to_one(spark, d):
    left, right = _tokens(spark, d)
    return J.one_to_one(left, right, ["capture_id", "post_tokens"], ["left_id"], ["right_id"])


def _pair_at(spark, d):
    a = activities(spark, d)
    left = a.where(M.is_run()).select("capture_id", F.col("activity_id").alias("run_id"), "ts")
    right = a.where(M.is_request()).select("capture_id", "ts", F.col("activity_id").alias("request_id"), F.col("ts").alias("request_ts"))
    return left, right


def q_asof_strict(spark, d):
    left, right = _pair_at(spark, d)
    return J.asof_backward(left, right, ["capture_id"], "ts", ["request_id", "request_ts"], ["request_id"], strict=True)


def q_asof_inclusive(spark, d):
    left, right = _pair_at(spark, d)
    left = left.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    right = right.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return J.asof_backward(left, right, ["capture_id"], "ts", ["request_id"], ["request_id"])


def q_asof_forward(spark, d):
    left, right = _pair_at(spark, d)
    return J.asof_forward(left, right, ["capture_id"], "ts", ["request_id"], ["request_id"])


def q_zip_join(spark, d):
    a = activities(spark, d)
    left = a.where(M.is_request()).select("capture_id", "ts", F.col("activity_id").alias("request_id"))
    right = a.where(M.is_run() & (F.col("category") == "lint")).select("capture_id", F.col("ts").alias("run_ts"), F.col("activity_id").alias("run_id"))
    day = lambda x, c: x.withColumn("day", F.to_date(c)).select("capture_id", "day", *[k for k in x.columns if k != "capture_id"])
    return J.zip_join(day(left, "ts"), day(right, "run_ts"), ["capture_id", "day"], ["ts", "request_id"], ["run_ts", "run_id"]).select("capture_id", "position", "request_id", "run_id")


def q_ordered_match(spark, d):
    a = activities(spark, d)
    left = a.where(M.is_request()).select("capture_id", "activity_id", (F.col("k") % 4).alias("a"), (F.col("k") % 3).alias("b"))
    right = a.where(M.is_edit()).select("capture_id", F.col("activity_id").alias("other_id"), (F.col("k") % 4).alias("a"), (F.col("k") % 3).alias("b"))
    return J.ordered_match(left, right, ["capture_id"], ["a", "b"], "activity_id", "other_id", "activity_id", "other_id")


def q_single_group_fallback(spark, d):
    """Rows without a model join the session's model if it has just one."""
    return R.sole_group(activities(spark, d), ["capture_id"], "model", "model_group").select("capture_id", "activity_id", "model_group")


def q_tree_match(spark, d):
    """Lines' parts to suppliers by key, else by a nation that has just one; a supplier claimed twice is refused."""
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 150).alias("want"), (F.col("p_size") % 25).alias("nation"))
    sup = table(spark, d, "supplier")
    first = parts.join(sup.select(F.col("s_suppkey").alias("want")), "want").select("p_partkey", F.col("want").alias("s_suppkey"), F.lit("key").alias("rung"))
    lone = sup.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n = 1")
    second = parts.join(first, "p_partkey", "left_anti").join(lone, "nation").select("p_partkey", "s_suppkey", F.lit("nation").alias("rung"))
    both = first.unionByName(second)
    claims = F.count("*").over(Window.partitionBy("s_suppkey"))
    return both.withColumn("claims", claims).select("p_partkey", "rung", F.when(F.col("claims") == 1, F.col("s_suppkey")).alias("s_suppkey"), "claims")


def _lineage(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", (F.row_number().over(timeline(["o_custkey"], ["o_orderdate", "o_orderkey"])) - 1).cast("long").alias("idx"))


def q_range_next3(spark, d):
    """Whether a large order follows within the next three, null until those exist."""
    w = timeline(["o_custkey"], ["idx"])
    rows = _lineage(spark, d).withColumn("closes", F.lead("o_orderdate", 3).over(w))
    ahead = F.max((F.col("o_totalprice") > 400_000).cast("int")).over(w.rowsBetween(1, 3))
    return rows.select("o_custkey", "o_orderkey", "closes", F.when(F.col("closes").isNotNull(), ahead).alias("rework"))


def q_lag_label(spark, d):
    w = timeline(["o_custkey"], ["idx"])
    return _lineage(spark, d).select("o_custkey", "idx", F.lag("o_totalprice", 3).over(w).alias("label"), F.array_join(F.array_distinct(F.array_compact(F.array("o_orderkey", F.lag("o_orderkey", 3).over(w)))), ",").alias("provenance"))


def q_band_overlap(spark, d):
    """The first of a customer's next three orders that shares a part with this one."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 40).alias("part")).distinct()
    rows = _lineage(spark, d).select("o_custkey", "o_orderkey", "idx").join(l, "o_orderkey")
    a = rows.select("o_custkey", "part", "o_orderkey", "idx")
    b = rows.select("o_custkey", "part", F.col("idx").alias("later"))
    return J.band_join(a, b, ["o_custkey", "part"], "idx", "later", 1, 3).groupBy("o_custkey", "o_orderkey").agg(F.min("later").alias("first_overlap"))


def q_interval_overlap(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    rows = o.join(l, "order_id").withColumn("b", F.when(F.col("order_id") % 5 != 0, F.col("b")))
    return J.interval_overlaps(rows, ["o_custkey"], "order_id", "a", "b", 180 * 86400)


def q_field_diff(spark, d):
    """Fields in which the members of a brand and size differ."""
    p = table(spark, d, "part").select("p_brand", "p_size", F.explode(F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))).alias("field", "value"))
    return p.groupBy("p_brand", "p_size", "field").agg(F.countDistinct("value").alias("values")).where("values > 1")


def _customers(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 17 != 0, F.col("c_mktsegment")).alias("segment"), F.col("n_regionkey").alias("region"), "c_nationkey", F.when(F.col("c_custkey") % 11 != 0, F.round("c_acctbal")).alias("balance"))


def q_cohort_members(spark, d):
    return C.cohort_sizes(_customers(spark, d), "c_custkey", ["segment", "region"])


def q_cohort_minus_group(spark, d):
    """Each nation's cohort: customers of its region that aren't its own, with the median balance, if there are ten."""
    c = _customers(spark, d)
    all_ = c.groupBy("region").agg(F.count("*").alias("n_all"))
    own = c.groupBy("region", "c_nationkey").agg(F.count("*").alias("n_own"))
    out = own.join(all_, "region").withColumn("n_cohort", F.col("n_all") - F.col("n_own"))
    return out.select("c_nationkey", "n_own", F.when(F.col("n_cohort") >= C.COHORT_MIN, F.col("n_cohort")).alias("n_cohort"))


def q_pair_difference(spark, d):
    m = M.evidence(M.base_metrics(activities(spark, d))).withColumn("unit", F.when(F.col("metric").like("%tokens"), "tokens").otherwise("count"))
    pairs = m.select(F.col("capture_id").alias("a"), (F.col("capture_id") + 1).alias("b")).distinct()
    return C.pair_difference(m, "capture_id", pairs).select("a", "b", "metric", "value_a", "value_b", "difference")


def q_provenance_check(spark, d):
    """Ids that a lineage row names but that are missing, or later than the row."""
    w = timeline(["o_custkey"], ["idx"])
    rows = _lineage(spark, d).withColumn("ids", F.array_compact(F.array("o_orderkey", F.lag("o_orderkey").over(w), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 1), F.when(F.col("o_orderkey") % 70 == 0, F.lit(-1).cast("long")))))
    named = rows.select("o_custkey", "idx", F.col("o_orderdate").alias("row_end"), F.explode("ids").alias("id"))
    seen = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return named.join(seen, "id", "left").where("at is null or at > row_end").select("o_custkey", "idx", "id", F.when(F.col("at").isNull(), "missing").otherwise("late").alias("problem"))


def q_explain_chain(spark, d):
    """From a metric to its activities to the events behind them, with the missing ones named."""
    a = activities(spark, d)
    src = a.where(M.is_snapshot()).groupBy("capture_id").agg(F.max_by("activity_id", F.struct("additions", "activity_id")).alias("source"))
    ids = src.select("capture_id", F.explode(F.array("source", F.col("source") + 1_000_000)).alias("event_id"))
    return ids.join(table(spark, d, "events").select("event_id", "event_type"), "event_id", "left").select("capture_id", "event_id", F.coalesce("event_type", F.lit("missing")).alias("stated"))


def q_midrank_percentile(spark, d):
    return C.midrank(_customers(spark, d), ["segment"], "balance").select("c_custkey", F.round("percentile", 1).alias("percentile"))


def q_distribution(spark, d):
    out = C.distribution(_customers(spark, d), ["region"], "balance")
    return out.select("region", "n", "unknown", *(F.round(c, 6).alias(c) for c in ("median", "mad", "iqr", "min", "max")))


def _weeks(column):
    year = F.expr(f"extract(YEAROFWEEK from {column})")
    return F.format_string("%04d-W%02d", year, F.weekofyear(column))


def q_profile_week(spark, d):
    e = table(spark, d, "events")
    out = C.distribution(e.withColumn("week", _weeks("ts")), ["week"], "value")
    whole = e.agg(F.percentile("value", 0.5).alias("cohort_median"))
    return out.crossJoin(F.broadcast(whole)).select("week", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round(F.try_divide(F.col("median"), F.col("cohort_median")), 6).alias("ratio"))


def q_profile_subsystem(spark, d):
    """Groups with several memberships: every folder above a path."""
    a = activities(spark, d).where("path is not null")
    parts = F.split("path", "/")
    subs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array(F.lit(".")))
    rows = a.select("capture_id", F.explode(subs).alias("subsystem"), "value")
    out = C.distribution(rows, ["subsystem"], "value")
    return out.join(rows.groupBy("subsystem").agg(F.countDistinct("capture_id").alias("captures")), "subsystem").select("subsystem", "captures", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


def q_composition(spark, d):
    return _customers(spark, d).groupBy(F.coalesce("segment", F.lit("unknown")).alias("word")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word")


def q_matrix_words(spark, d):
    a = activities(spark, d).where(M.is_request())
    return a.groupBy("model", F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("capture_id").alias("captures"), F.count_if(F.col("output").isNull()).alias("unavailable"), F.count_if(F.col("output").isNotNull()).alias("observed"))


def q_retention(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.expr("datediff(DATE'2024-02-01', cast(min(ts) as date))").cast("long").alias("age_days"))


def q_verdict(spark, d):
    r = activities(spark, d).where(M.is_run())
    return r.groupBy("capture_id", "category").agg(
        F.when(F.bool_or(~F.col("success")), "fail").when(F.bool_and(F.coalesce("success", F.lit(False))), "pass").otherwise("unread").alias("verdict"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("span_s")
    )


def q_pivot_zero_fill(spark, d):
    """Calls by agent; zero only where the session has a stream of requests, else unknown."""
    a = activities(spark, d)
    calls = a.where(M.is_tool()).groupBy("capture_id").pivot("agent", [f"a{i}" for i in range(0, 6, 2)]).count()
    seen = a.groupBy("capture_id").agg(F.bool_or(M.is_request() & (F.col("k") < 3)).alias("stream"))
    out = seen.join(calls, "capture_id", "left")
    return out.select("capture_id", *(F.coalesce(F.col(c), F.when(F.col("stream"), F.lit(0).cast("long"))).alias(c) for c in ("a0", "a2", "a4")))


def q_top_groups(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(5)


def _arms(spark, d):
    """Balances (in whole units) of two segments, by nation."""
    c = table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')")
    return c.select("c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", "a").otherwise("b").alias("arm"), F.round(F.col("c_acctbal") / 10).alias("value"))


def q_hodges_lehmann(spark, d):
    return C.hodges_lehmann(_arms(spark, d), ["c_nationkey"], "arm", "value").where("hl_shift is not null")


def q_cliffs_delta(spark, d):
    return C.arm_ranks(_arms(spark, d), ["c_nationkey"], "arm", "value").select("c_nationkey", "n_a", "n_b", F.round("cliffs_delta", 9).alias("cliffs_delta"))


def q_mann_whitney(spark, d):
    return C.mann_whitney(_arms(spark, d), ["c_nationkey"], "arm", "value").drop("p")


def q_mann_whitney_p(spark, d):
    return C.mann_whitney(_arms(spark, d), ["c_nationkey"], "arm", "value")


def q_mdd(spark, d):
    rows = _arms(spark, d)
    dist = C.distribution(rows, ["c_nationkey", "arm"], "value")
    wide = dist.groupBy("c_nationkey").agg(*(F.max(F.when(F.col("arm") == x, F.col(c))).alias(f"{c}_{x}") for x in ("a", "b") for c in ("n", "mad", "median")))
    pooled = rows.groupBy("c_nationkey").agg(F.percentile("value", 0.5).alias("pooled"))
    j = wide.join(pooled, "c_nationkey").where("n_a > 0 and n_b > 0")
    r = C.resolution(F.least("n_a", "n_b"), F.col("mad_a"), F.col("mad_b"), F.col("pooled"), F.col("median_b") - F.col("median_a"))
    return j.select("c_nationkey", F.round(r["s"], 6).alias("s"), F.round(r["mdd"], 6).alias("mdd"), r["n_needed"].alias("n_needed"), r["demoted"].alias("demoted"), r["label"].alias("label"))


def q_kfold_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.hash_fold(F.col("c_custkey")).alias("fold"))


def q_auc_brier_spearman(spark, d):
    a = activities(spark, d).where(M.is_run() & F.col("success").isNotNull()).select("category", F.col("success").cast("int").alias("y"), (F.round(F.col("k") / 100.0, 1)).alias("p"))
    out = C.auc_brier_spearman(a, ["category"], "y", "p")
    return out.select("category", "n", *(F.round(c, 9).alias(c) for c in ("auc", "brier", "spearman")))


def q_past_features(spark, d):
    """Per run: failures among the last five runs, and edits since the last run."""
    a = activities(spark, d).where(M.is_edit() | M.is_run())
    over = timeline(M.KEY, M.ORDER)
    edits = F.sum(M.is_edit().cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    runs = a.withColumn("edits", F.coalesce(edits, F.lit(0))).where(M.is_run())
    last5 = over.rowsBetween(-5, -1)
    return runs.select("capture_id", "activity_id", F.coalesce(F.sum(F.coalesce((~F.col("success")).cast("int"), F.lit(0))).over(last5), F.lit(0)).alias("failed_of_5"), (F.col("edits") - F.coalesce(F.lag("edits").over(over), F.lit(0))).alias("edits_since_run"))


def q_prefix_features(spark, d):
    """Features of a session's first 16 activities against what remains."""
    a = activities(spark, d).withColumn("n", F.row_number().over(timeline(M.KEY, M.ORDER)))
    head = F.col("n") <= 16
    return a.groupBy("capture_id").agg(
        F.count_if(head & M.is_edit()).alias("head_edits"), F.sum(F.when(head, F.col("fresh"))).alias("head_fresh"), F.round(F.percentile(F.when(head, F.col("value")), 0.5), 6).alias("head_median"), F.sum(F.when(~head, F.col("fresh"))).alias("rest_fresh")
    )


def q_markov(spark, d):
    a = activities(spark, d).withColumn("fold", C.hash_fold(F.col("capture_id")))
    out = C.markov(a, M.KEY, M.ORDER, "kind", "fold", 0)
    return out.select("n", *(F.round(f"{c}{k}", 9).alias(f"{c}{k}") for c in ("loss", "accuracy") for k in range(3)))


LINEAGE = "l AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders)"
SURFACES = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice * 100)::BIGINT END AS cents, o_orderstatus AS status FROM orders),
  s AS (SELECT l_orderkey AS o_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS lines, max(l_linestatus) AS status FROM lineitem GROUP BY 1)"""
CUST = "c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS segment, n_regionkey AS region, c_nationkey, CASE WHEN c_custkey % 11 <> 0 THEN round(c_acctbal) END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ARMS = "v AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'a' ELSE 'b' END AS arm, round(c_acctbal / 10) AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"
DIST = "SELECT {g}, count({v}) AS n, count(*) FILTER ({v} IS NULL) AS unknown, median({v}) AS median, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr, min({v}) AS min, max({v}) AS max FROM {t} GROUP BY {g}"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "ordered_match": ACT.replace("WITH ", "WITH RECURSIVE ", 1) + """, lf AS (SELECT capture_id, activity_id, k % 4 AS a, k % 3 AS b, row_number() OVER (PARTITION BY capture_id ORDER BY activity_id) AS n FROM act WHERE kind = 'model_request'),
  rt AS (SELECT capture_id, activity_id AS other_id, k % 4 AS a, k % 3 AS b, row_number() OVER (PARTITION BY capture_id ORDER BY activity_id) AS pos FROM act WHERE kind = 'file_edit'),
  w AS (SELECT DISTINCT capture_id, 0::BIGINT AS n, 0::BIGINT AS place, NULL::BIGINT AS activity_id, false AS hit FROM lf
    UNION ALL SELECT capture_id, n, coalesce(found, place), activity_id, found IS NOT NULL
    FROM (SELECT l.capture_id, l.n, w.place, l.activity_id, (SELECT min(pos) FROM rt WHERE rt.capture_id = l.capture_id AND rt.a = l.a AND rt.b = l.b AND rt.pos > w.place) AS found
      FROM w JOIN lf l ON l.capture_id = w.capture_id AND l.n = w.n + 1))
  SELECT w.capture_id, w.activity_id, other_id FROM w JOIN rt ON rt.capture_id = w.capture_id AND rt.pos = w.place WHERE hit""",
    "surface_coalesce": f"WITH {SURFACES} SELECT o_orderkey, coalesce(o.cents, s.cents) AS cents, s.lines AS lines, coalesce(o.status, s.status) AS status, CASE WHEN o.cents IS NOT NULL THEN 'stated' WHEN s.cents IS NOT NULL THEN 'lines' END AS cents_from FROM o FULL JOIN s USING (o_orderkey)",
    "stream_only_union": "WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) SELECT o_orderkey, 'primary' AS origin FROM o UNION ALL SELECT DISTINCT l_orderkey, 'lines' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)",
    "surface_conflicts": f"WITH {SURFACES} SELECT o_orderkey, o.cents AS stated, s.cents AS cents, o.status <> s.status AS status_differs FROM o JOIN s USING (o_orderkey) WHERE o.cents <> s.cents",
    "unique_match": "SELECT p_partkey, p_brand, p_size, only_part FROM part LEFT JOIN (SELECT p_brand, p_size, min(p_partkey) AS only_part FROM part WHERE p_partkey % 9 = 0 GROUP BY ALL HAVING count(*) = 1) USING (p_brand, p_size)",
    "value_match_one_to_one": ACT + """, a AS (SELECT capture_id, post_tokens, activity_id AS left_id, row_number() OVER (PARTITION BY capture_id, post_tokens ORDER BY activity_id) AS n FROM act WHERE kind = 'compaction'),
      b AS (SELECT *, row_number() OVER (PARTITION BY capture_id, post_tokens ORDER BY right_id) AS n FROM (SELECT capture_id, CASE WHEN k % 3 <> 0 THEN ((k - 2) * 10)::BIGINT END AS post_tokens, activity_id AS right_id FROM act WHERE kind = 'compaction' AND k % 2 = 1))
      SELECT coalesce(a.capture_id, b.capture_id) AS capture_id, CASE WHEN a.n IS NOT NULL THEN a.post_tokens ELSE b.post_tokens END AS post_tokens, left_id, right_id FROM a FULL JOIN b ON a.capture_id = b.capture_id AND a.post_tokens IS NOT DISTINCT FROM b.post_tokens AND a.n = b.n""",
    "asof_strict": ACT + " SELECT r.capture_id, r.activity_id AS run_id, r.ts, q.activity_id AS request_id, q.ts AS request_ts FROM (SELECT * FROM act WHERE kind = 'verification_run') r ASOF LEFT JOIN (SELECT * FROM act WHERE kind = 'model_request') q ON r.capture_id = q.capture_id AND r.ts > q.ts",
    "asof_inclusive": ACT + """ SELECT r.capture_id, r.activity_id AS run_id, date_trunc('hour', r.ts) AS ts, (SELECT max_by(q.activity_id, (date_trunc('hour', q.ts), q.activity_id)) FROM act q WHERE q.kind = 'model_request' AND q.capture_id = r.capture_id AND date_trunc('hour', q.ts) <= date_trunc('hour', r.ts)) AS request_id
      FROM act r WHERE r.kind = 'verification_run'""",
    "asof_forward": ACT + " SELECT r.capture_id, r.activity_id AS run_id, r.ts, q.activity_id AS request_id FROM (SELECT * FROM act WHERE kind = 'verification_run') r ASOF LEFT JOIN (SELECT * FROM act WHERE kind = 'model_request') q ON r.capture_id = q.capture_id AND r.ts <= q.ts",
    "zip_join": ACT + """, a AS (SELECT capture_id, ts::DATE AS day, activity_id AS request_id, row_number() OVER (PARTITION BY capture_id, ts::DATE ORDER BY ts, activity_id) AS position, count(*) OVER (PARTITION BY capture_id, ts::DATE) AS n FROM act WHERE kind = 'model_request'),
      b AS (SELECT capture_id, ts::DATE AS day, activity_id AS run_id, row_number() OVER (PARTITION BY capture_id, ts::DATE ORDER BY ts, activity_id) AS position, count(*) OVER (PARTITION BY capture_id, ts::DATE) AS n FROM act WHERE category = 'lint')
      SELECT capture_id, position::INTEGER AS position, request_id, run_id FROM a JOIN b USING (capture_id, day, position, n)""",
    "single_group_fallback": ACT + ", a AS (SELECT * FROM act), o AS (SELECT capture_id, count(DISTINCT model) AS n, min(model) AS only_one FROM a GROUP BY 1) SELECT capture_id, activity_id, coalesce(model, CASE WHEN n = 1 THEN only_one END) AS model_group FROM a JOIN o USING (capture_id)",
    "tree_match": """WITH p AS (SELECT p_partkey, p_partkey % 150 AS want, p_size % 25 AS nation FROM part), f AS (SELECT p_partkey, want AS s_suppkey, 'key' AS rung FROM p WHERE want IN (SELECT s_suppkey FROM supplier)),
      b AS (SELECT * FROM f UNION ALL SELECT p_partkey, s, 'nation' FROM p JOIN (SELECT s_nationkey AS nation, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = 1) USING (nation) WHERE p_partkey NOT IN (SELECT p_partkey FROM f)),
      c AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS claims FROM b) SELECT p_partkey, rung, CASE WHEN claims = 1 THEN s_suppkey END AS s_suppkey, claims FROM c""",
    "range_next3": f"WITH {LINEAGE} SELECT o_custkey, o_orderkey, closes, CASE WHEN closes IS NOT NULL THEN ahead END AS rework FROM (SELECT *, lead(o_orderdate, 3) OVER w AS closes, max((o_totalprice > 400000)::INT) OVER (PARTITION BY o_custkey ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY idx))",
    "lag_label": f"WITH {LINEAGE} SELECT o_custkey, idx, lag(o_totalprice, 3) OVER w AS label, concat_ws(',', o_orderkey, lag(o_orderkey, 3) OVER w) AS provenance FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY idx)",
    "band_overlap": f"WITH {LINEAGE}, r AS (SELECT DISTINCT o_custkey, o_orderkey, idx, l_partkey % 40 AS part FROM l JOIN lineitem ON l_orderkey = o_orderkey) SELECT a.o_custkey, a.o_orderkey, min(b.idx) AS first_overlap FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.part = b.part AND b.idx BETWEEN a.idx + 1 AND a.idx + 3 GROUP BY ALL",
    "interval_overlap": """WITH r AS (SELECT o_custkey, o_orderkey AS id, min(l_shipdate) AS a, CASE WHEN o_orderkey % 5 <> 0 THEN max(l_shipdate) END AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey)
      SELECT x.o_custkey, x.id AS left_id, y.id AS right_id FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.id < y.id AND (y.b IS NULL OR x.a < y.b) AND (x.b IS NULL OR y.a < x.b)""",
    "field_diff": "SELECT p_brand, p_size, 'name' AS field, count(DISTINCT p_name) AS \"values\" FROM part GROUP BY ALL HAVING count(DISTINCT p_name) > 1 UNION ALL SELECT p_brand, p_size, 'type', count(DISTINCT p_type) FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1",
    "cohort_members": f"WITH {CUST} SELECT c_custkey, CASE WHEN segment IS NOT NULL THEN count(*) OVER (PARTITION BY segment, region) - 1 END AS n FROM c",
    "cohort_minus_group": f"WITH {CUST} SELECT c_nationkey, count(*) AS n_own, CASE WHEN x - count(*) >= 10 THEN x - count(*) END AS n_cohort FROM c JOIN (SELECT region, count(*) AS x FROM c GROUP BY 1) USING (region) GROUP BY c_nationkey, x",
    "provenance_check": f"""WITH {LINEAGE}, n AS (SELECT o_custkey, idx, o_orderdate AS row_end, unnest(list_filter([o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY idx), CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 END, CASE WHEN o_orderkey % 70 = 0 THEN -1 END], lambda x: x IS NOT NULL)) AS id FROM l)
      SELECT n.o_custkey, idx, id, CASE WHEN o.o_orderdate IS NULL THEN 'missing' ELSE 'late' END AS problem FROM n LEFT JOIN orders o ON o.o_orderkey = id WHERE o.o_orderdate IS NULL OR o.o_orderdate > row_end""",
    "explain_chain": ACT + ", s AS (SELECT capture_id, arg_max(activity_id, (additions, activity_id)) AS source FROM act WHERE kind = 'repo_snapshot' GROUP BY 1), i AS (SELECT capture_id, unnest([source, source + 1000000]) AS event_id FROM s) SELECT capture_id, event_id, coalesce(event_type, 'missing') AS stated FROM i LEFT JOIN events USING (event_id)",
    "midrank_percentile": f"WITH {CUST} SELECT c_custkey, CASE WHEN balance IS NOT NULL AND segment IS NOT NULL AND n >= 10 THEN round(100.0::DOUBLE * (r - 1 + s / 2.0::DOUBLE) / n, 1) END AS percentile FROM (SELECT *, rank() OVER (PARTITION BY segment, balance IS NULL ORDER BY balance) AS r, count(*) OVER (PARTITION BY segment, balance) AS s, count(balance) OVER (PARTITION BY segment) AS n FROM c)",
    "distribution": f"WITH {CUST}, b AS (" + DIST.format(g="region", v="balance", t="c") + "), m AS (SELECT region, median(abs(balance - median)) * 1.4826::DOUBLE AS mad FROM c JOIN b USING (region) GROUP BY 1) SELECT region, n, unknown, round(median, 6) AS median, round(CASE WHEN n > 1 THEN mad END, 6) AS mad, round(CASE WHEN n > 1 THEN iqr END, 6) AS iqr, min, max FROM b JOIN m USING (region)",
    "profile_week": "WITH e AS (SELECT *, printf('%04d-W%02d', isoyear(ts), weekofyear(ts)) AS week FROM events), b AS (" + DIST.format(g="week", v="value", t="e") + "), m AS (SELECT week, median(abs(value - median)) * 1.4826::DOUBLE AS mad FROM e JOIN b USING (week) GROUP BY 1) SELECT week, n, round(median, 6) AS median, round(CASE WHEN n > 1 THEN mad END, 6) AS mad, round(median / (SELECT median(value) FROM events), 6) AS ratio FROM b JOIN m USING (week)",
    "profile_subsystem": ACT + ", s AS (SELECT capture_id, value, unnest(CASE WHEN contains(path, '/') THEN list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) ELSE ['.'] END) AS subsystem FROM act WHERE path IS NOT NULL) SELECT subsystem, count(DISTINCT capture_id) AS captures, count(*) AS n, round(median(value), 6) AS median, CASE WHEN count(*) > 1 THEN round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) END AS iqr FROM s GROUP BY 1",
    "composition": f"WITH {CUST} SELECT coalesce(segment, 'unknown') AS word, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, word",
    "matrix_words": ACT + " SELECT model, ts::DATE::VARCHAR AS day, count(DISTINCT capture_id) AS captures, count(*) FILTER (output IS NULL) AS unavailable, count(output) AS observed FROM act WHERE kind = 'model_request' GROUP BY ALL",
    "retention": "SELECT event_type, count(*) AS n, min(ts) AS oldest, datediff('day', min(ts)::DATE, DATE '2024-02-01') AS age_days FROM events GROUP BY 1",
    "verdict": ACT + " SELECT capture_id, category, CASE WHEN bool_or(NOT success) THEN 'fail' WHEN bool_and(coalesce(success, false)) THEN 'pass' ELSE 'unread' END AS verdict, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS span_s FROM act WHERE kind = 'verification_run' GROUP BY ALL",
    "pivot_zero_fill": ACT + ", s AS (SELECT capture_id, bool_or(kind = 'model_request' AND k < 3) AS stream, " + ", ".join(f"nullif(count(*) FILTER (agent = 'a{i}'), 0) AS n{i}" for i in (0, 2, 4)) + " FROM act GROUP BY 1) SELECT capture_id, " + ", ".join(f"coalesce(n{i}, CASE WHEN stream THEN 0 END) AS a{i}" for i in (0, 2, 4)) + " FROM s",
    "top_groups": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5",
    "hodges_lehmann": f"WITH {ARMS} SELECT a.c_nationkey, median(b.value - a.value) AS hl_shift FROM v a JOIN v b ON a.c_nationkey = b.c_nationkey AND a.arm = 'a' AND b.arm = 'b' GROUP BY 1",
    "cliffs_delta": f"WITH {ARMS}, n AS (SELECT c_nationkey, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b FROM v GROUP BY 1) SELECT c_nationkey, n_a, n_b, (SELECT round(avg(sign(b.value - a.value)), 9) FROM v a JOIN v b ON a.c_nationkey = b.c_nationkey WHERE a.arm = 'a' AND b.arm = 'b' AND a.c_nationkey = n.c_nationkey) AS cliffs_delta FROM n",
    "mann_whitney": f"WITH {ARMS}, n AS (SELECT c_nationkey, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b FROM v GROUP BY 1) SELECT c_nationkey, n_a, n_b, coalesce((SELECT sum(CASE WHEN b.value > a.value THEN 1.0::DOUBLE WHEN b.value = a.value THEN 0.5::DOUBLE ELSE 0 END) FROM v a JOIN v b ON a.c_nationkey = b.c_nationkey WHERE a.arm = 'a' AND b.arm = 'b' AND a.c_nationkey = n.c_nationkey), 0.0) AS u FROM n",
    "mann_whitney_p": f"""WITH RECURSIVE {ARMS}, n AS (SELECT c_nationkey, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b FROM v GROUP BY 1),
      x AS MATERIALIZED (SELECT c_nationkey, arm, value, (2 * rank() OVER g + count(*) OVER (PARTITION BY c_nationkey, value) - 1)::BIGINT AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY value, arm) AS i
        FROM v WHERE value IS NOT NULL WINDOW g AS (PARTITION BY c_nationkey ORDER BY value)),
      s AS MATERIALIZED (SELECT * FROM n WHERE n_a BETWEEN 1 AND 20 AND n_b BETWEEN 1 AND 20),
      dp AS (SELECT c_nationkey, 0::BIGINT AS i, 0::BIGINT AS k, 0::BIGINT AS total, 1.0::DOUBLE AS ways FROM s
        UNION ALL SELECT c_nationkey, i, k, total, sum(ways) FROM (SELECT x.c_nationkey, x.i, dp.k + t AS k, dp.total + t * x.d AS total, dp.ways
          FROM dp JOIN x ON x.c_nationkey = dp.c_nationkey AND x.i = dp.i + 1 JOIN s ON s.c_nationkey = dp.c_nationkey, (VALUES (0), (1)) c(t) WHERE dp.k + t <= s.n_a) GROUP BY ALL),
      o AS (SELECT c_nationkey, sum(d) AS whole, sum(d) FILTER (arm = 'a') AS seen, count(*) AS n FROM x GROUP BY 1),
      p AS (SELECT dp.c_nationkey, sum(ways) FILTER (abs(total * o.n - s.n_a * whole) >= abs(seen * o.n - s.n_a * whole)) / sum(ways) AS p FROM dp JOIN o USING (c_nationkey) JOIN s USING (c_nationkey)
        WHERE dp.i = o.n AND dp.k = s.n_a GROUP BY 1)
      SELECT c_nationkey, n_a, n_b, coalesce((SELECT sum(CASE WHEN b.value > a.value THEN 1.0::DOUBLE WHEN b.value = a.value THEN 0.5::DOUBLE ELSE 0 END) FROM v a JOIN v b ON a.c_nationkey = b.c_nationkey
        WHERE a.arm = 'a' AND b.arm = 'b' AND a.c_nationkey = n.c_nationkey), 0.0) AS u, p FROM n LEFT JOIN p USING (c_nationkey)""",
    "mdd": f"""WITH {ARMS}, b AS (SELECT c_nationkey, arm, count(*) AS n, median(value) AS med FROM v GROUP BY ALL), m AS (SELECT c_nationkey, arm, n, med, CASE WHEN n > 1 THEN median(abs(value - med)) * 1.4826::DOUBLE END AS mad FROM v JOIN b USING (c_nationkey, arm) GROUP BY c_nationkey, arm, n, med),
      w AS (SELECT a.c_nationkey, least(a.n, b.n) AS n, sqrt((a.mad ** 2 + b.mad ** 2) / 2) AS s, b.med - a.med AS shift, (SELECT median(value) FROM v WHERE v.c_nationkey = a.c_nationkey) AS p FROM m a JOIN m b ON a.c_nationkey = b.c_nationkey AND a.arm = 'a' AND b.arm = 'b')
      SELECT c_nationkey, round(s, 6) AS s, round(2.8::DOUBLE * s * sqrt(2.0::DOUBLE / n), 6) AS mdd, CASE WHEN p <> 0 THEN ceil(2.0::DOUBLE * (2.8::DOUBLE * s / (0.25::DOUBLE * abs(p))) ** 2)::BIGINT END AS n_needed, 2.8::DOUBLE * s * sqrt(2.0::DOUBLE / n) > 0.25::DOUBLE * abs(p) AS demoted,
        CASE WHEN s IS NOT NULL THEN CASE WHEN abs(shift) > 2.8::DOUBLE * s * sqrt(2.0::DOUBLE / n) THEN 'material environment effect' ELSE 'not resolved at n' END END AS label FROM w""",
    "kfold_hash": "SELECT c_custkey, (list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(sha256(c_custkey::VARCHAR), i, 1))::INTEGER)) % 5)::INTEGER AS fold FROM customer",
    "auc_brier_spearman": ACT + """, r AS (SELECT category, success::INT AS y, round(k / 100.0::DOUBLE, 1) AS p FROM act WHERE success IS NOT NULL),
      x AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY p) + (count(*) OVER (PARTITION BY category, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY category ORDER BY y) + (count(*) OVER (PARTITION BY category, y) - 1) / 2.0::DOUBLE AS ry FROM r)
      SELECT category, count(*) AS n, round((sum(rp) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 9) AS auc, round(avg((y - p) ** 2), 9) AS brier, round(corr(rp, ry), 9) AS spearman FROM x GROUP BY 1""",
    "past_features": ACT + """, x AS (SELECT *, coalesce(sum((kind = 'file_edit')::INT) OVER (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS edits FROM act WHERE kind IN ('file_edit', 'verification_run'))
      SELECT capture_id, activity_id, coalesce(sum(CASE WHEN NOT success THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY ts, activity_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failed_of_5, (edits - coalesce(lag(edits) OVER (PARTITION BY capture_id ORDER BY ts, activity_id), 0))::BIGINT AS edits_since_run FROM x WHERE kind = 'verification_run'""",
    "prefix_features": ACT + ", x AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, activity_id) AS n FROM act) SELECT capture_id, count(*) FILTER (n <= 16 AND kind = 'file_edit') AS head_edits, (sum(fresh) FILTER (n <= 16))::BIGINT AS head_fresh, round(median(value) FILTER (n <= 16), 6) AS head_median, (sum(fresh) FILTER (n > 16))::BIGINT AS rest_fresh FROM x GROUP BY 1",
    "markov": ACT + """, f AS (SELECT capture_id, list_sum(list_transform(range(1, 65), lambda i: ('0x' || substr(sha256(capture_id::VARCHAR), i, 1))::INTEGER)) % 5 AS fold FROM (SELECT DISTINCT capture_id FROM act)),
      t AS (SELECT fold, kind AS s, lag(kind) OVER o AS p, lag(kind, 2) OVER o AS pp FROM act JOIN f USING (capture_id) WINDOW o AS (PARTITION BY capture_id ORDER BY ts, activity_id)), u AS (SELECT * FROM t WHERE p IS NOT NULL),
      z AS (SELECT s, p, pp, (SELECT count(DISTINCT s) FROM u) AS v, (SELECT count(*) FROM u WHERE fold <> 0) AS n0 FROM u WHERE fold = 0), g AS (SELECT * FROM u WHERE fold <> 0),
      a AS (SELECT z.*, (SELECT count(*) FROM g WHERE g.s = z.s) AS f0, (SELECT count(*) FROM g WHERE g.p = z.p) AS n1, (SELECT count(*) FROM g WHERE g.p = z.p AND g.s = z.s) AS f1, (SELECT count(*) FROM g WHERE g.p = z.p AND g.pp = z.pp) AS n2, (SELECT count(*) FROM g WHERE g.p = z.p AND g.pp = z.pp AND g.s = z.s) AS f2 FROM z),
      l0 AS (SELECT arg_min(s, (-c, s)) AS g0 FROM (SELECT s, count(*) AS c FROM g GROUP BY s)), l1 AS (SELECT p, arg_min(s, (-c, s)) AS g1 FROM (SELECT p, s, count(*) AS c FROM g GROUP BY ALL) GROUP BY p),
      l2 AS (SELECT pp, p, arg_min(s, (-c, s)) AS g2 FROM (SELECT pp, p, s, count(*) AS c FROM g WHERE pp IS NOT NULL GROUP BY ALL) GROUP BY ALL),
      h AS (SELECT a.*, g0, CASE WHEN n1 >= 20 THEN g1 ELSE g0 END AS g1, CASE WHEN a.pp IS NOT NULL AND n2 >= 20 THEN g2 WHEN n1 >= 20 THEN g1 ELSE g0 END AS g2 FROM a CROSS JOIN l0 LEFT JOIN l1 USING (p) LEFT JOIN l2 ON l2.pp = a.pp AND l2.p = a.p),
      b AS (SELECT *, (f0 + 1) / (n0 + v)::DOUBLE AS p0, CASE WHEN n1 >= 20 THEN (f1 + 1) / (n1 + v)::DOUBLE END AS q1, CASE WHEN pp IS NOT NULL AND n2 >= 20 THEN (f2 + 1) / (n2 + v)::DOUBLE END AS q2 FROM h)
      SELECT count(*) AS n, round(avg((s = g0)::INT), 9) AS accuracy0, round(avg((s = g1)::INT), 9) AS accuracy1, round(avg((s = g2)::INT), 9) AS accuracy2, round(-avg(ln(p0)), 9) AS loss0, round(-avg(ln(coalesce(q1, p0))), 9) AS loss1, round(-avg(ln(coalesce(q2, q1, p0))), 9) AS loss2 FROM b""",
}


def _pairs_sql() -> str:
    from .sessions import SQL as S

    return f"""WITH ev AS MATERIALIZED ({S['evidence_long']}), p AS (SELECT DISTINCT capture_id AS a, capture_id + 1 AS b FROM ev), m AS (SELECT DISTINCT metric FROM ev)
      SELECT p.a, p.b, m.metric, x.value AS value_a, y.value AS value_b, y.value - x.value AS difference FROM p CROSS JOIN m LEFT JOIN ev x ON x.capture_id = p.a AND x.metric = m.metric LEFT JOIN ev y ON y.capture_id = p.b AND y.metric = m.metric"""


SQL["pair_difference"] = _pairs_sql()
