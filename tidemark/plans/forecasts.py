"""Queries of the forecast laboratory over the weekly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as L
from ..operators import forecasters as P
from .series import REGIMES, weekly_series, with_regimes


def _true(spark, d):
    return with_regimes(weekly_series(spark, d)).select("series_id", F.lit("true").alias("ordering"), "row_index", "y", "regime_start", "changepoint")


def _whole(spark, d):
    """The series without unknown rows and regimes, so that every order has the same windows."""
    s = weekly_series(spark, d).select("series_id", "row_index", F.coalesce("y", F.lit(0.0)).alias("y"))
    return s.select("series_id", F.lit("true").alias("ordering"), "row_index", "y", F.lit(0).cast("long").alias("regime_start"), F.lit(False).alias("changepoint"))


def _placebo(spark, d):
    s = _whole(spark, d)
    return L.with_true_regimes(L.block_shuffle(s, 2), s)


def _out(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c in names))


def q_backtest_plan(spark, d):
    return L.plan(_true(spark, d), 4).select("series_id", "origin", "ctx_start", "dropped")


def q_dropped_counts(spark, d):
    return L.plan(_true(spark, d), 4).groupBy("series_id", F.coalesce("dropped", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def q_rolling_baselines(spark, d):
    f = L.forecasts(_true(spark, d), 1)
    return f.select("series_id", "origin", *(F.round(F.col(b)[0], 6).alias(b) for b in L.BASELINES))


def q_backtest_mae(spark, d):
    return _out(L.backtest(_true(spark, d), 4), "series_id", "origin", "forecaster", "mae")


def q_backtest_scores(spark, d):
    return _out(L.scores(L.backtest(_true(spark, d), 4)), "series_id", "forecaster", "n", "mae_mean", "mae_median", "best_baseline", "skill")


def q_calibration(spark, d):
    return _out(L.calibration(L.banded(_true(spark, d), 4)), "series_id", "level", "n", "coverage")


def q_wqs(spark, d):
    return _out(L.weighted_quantile_score(L.banded(_true(spark, d), 4)), "series_id", "wqs")


def q_tau(spark, d):
    return _out(L.threshold(_true(spark, d)), "series_id", "tau")


def q_lead_time(spark, d):
    s = _whole(spark, d)
    out = L.lead_times(L.banded(s, 4), L.threshold(s))
    return _out(out, "series_id", "eligible", "hits", "misses", "false_alarms", "quiet", "median_timing")


def q_block_shuffle(spark, d):
    return L.block_shuffle(_whole(spark, d), 2).select("series_id", "ordering", "row_index", "y")


def q_sentinel(spark, d):
    true = L.scores(L.backtest(_whole(spark, d), 4))
    return L.sentinel(true, L.scores(L.backtest(_placebo(spark, d), 4)))


def q_decision(spark, d):
    true, fake = L.backtest(_whole(spark, d), 4), L.backtest(_placebo(spark, d), 4)
    out = L.decide(true, fake, None, "rolling_mean")
    return _out(out, "series_id", "n", "e_m", "e_b", "e_p", "w_mb", "w_mp", "label")


def q_forecaster_protocol(spark, d):
    """A forecaster that is only a function of its window, the mean of the last eight values, run at every kept origin."""
    mean8 = P.Named("mean8", lambda w: [float(w.context[-L.BASELINE_WINDOW:].mean())] * w.horizon)
    return _out(P.run_forecaster(_true(spark, d), 4, mean8), "series_id", "origin", "mae")


def q_ablation_align(spark, d):
    """Origins that all three horizons keep, with each one's best mean error."""
    runs = None
    for name, h in (("A", 1), ("B", 2), ("C", 4)):
        one = L.backtest(_true(spark, d), h).where("forecaster = 'rolling_mean'").select("series_id", "origin", F.lit(name).alias("run"), "mae")
        runs = one if runs is None else runs.unionByName(one)
    wide = runs.groupBy("series_id", "origin").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("run") == r, F.col("mae"))).alias(r.lower()) for r in "ABC")).where("n = 3")
    return _out(wide, "series_id", "origin", "a", "b", "c")


def q_candidate_paired(spark, d):
    """Median paired difference of two forecasters over common origins."""
    r = L.backtest(_true(spark, d), 4)
    j = r.groupBy("series_id", "origin").agg(F.max(F.when(F.col("forecaster") == "rolling_mean", F.col("mae"))).alias("x"), F.max(F.when(F.col("forecaster") == "persistence", F.col("mae"))).alias("y"))
    return _out(j.groupBy("series_id").agg(F.count("*").alias("n"), F.percentile(F.col("x") - F.col("y"), 0.5).alias("shift"), F.avg((F.col("x") < F.col("y")).cast("double")).alias("share")), "series_id", "n", "shift", "share")


def q_readiness(spark, d):
    return L.readiness(_true(spark, d), 4).drop("ordering")


PLAN = REGIMES + """, pl AS (SELECT a.series_id, a.row_index AS origin, greatest(a.regime_start, a.row_index - 512) AS ctx_start, CASE WHEN a.row_index - greatest(a.regime_start, a.row_index - 512) < 32 THEN 'regime_too_short'
    WHEN EXISTS (SELECT 1 FROM r b WHERE b.series_id = a.series_id AND b.changepoint AND b.row_index > a.row_index AND b.row_index < a.row_index + {h}) THEN 'changepoint_in_horizon'
    WHEN EXISTS (SELECT 1 FROM r b WHERE b.series_id = a.series_id AND b.y IS NULL AND b.row_index >= greatest(a.regime_start, a.row_index - 512) AND b.row_index < a.row_index) THEN 'missing_context_value'
    WHEN EXISTS (SELECT 1 FROM r b WHERE b.series_id = a.series_id AND b.y IS NULL AND b.row_index >= a.row_index AND b.row_index < a.row_index + {h}) THEN 'missing_actual_value' END AS dropped
  FROM r a WHERE a.row_index >= 32 AND a.row_index <= (SELECT count(*) FROM r c WHERE c.series_id = a.series_id) - {h} AND (a.row_index - 32) % {h} = 0)"""
BASE = """bs AS (SELECT {k}, row_index AS origin, lag(y) OVER w AS persistence, avg(y) OVER p AS rolling_mean, median(y) OVER p AS rolling_median, (lag(y) OVER w - lag(y, 9) OVER w) / 8 AS slope FROM {t}
  WINDOW w AS (PARTITION BY {k} ORDER BY row_index), p AS (PARTITION BY {k} ORDER BY row_index ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""
RUNS = """rn AS (SELECT {k2}, p.origin, f.forecaster, round(avg(abs(x.y - CASE f.forecaster WHEN 'persistence' THEN b.persistence WHEN 'rolling_mean' THEN b.rolling_mean WHEN 'rolling_median' THEN b.rolling_median ELSE b.persistence + b.slope * (x.row_index - p.origin + 1) END)), 6) AS mae
  FROM {p} p JOIN bs b ON {on} AND b.origin = p.origin JOIN {t} x ON {onx} AND x.row_index >= p.origin AND x.row_index < p.origin + {h} CROSS JOIN (VALUES ('local_drift'), ('persistence'), ('rolling_mean'), ('rolling_median')) f(forecaster) GROUP BY {k2}, p.origin, f.forecaster)"""


def _runs(h: int) -> str:
    return "WITH " + PLAN.format(h=h) + ", kp AS (SELECT * FROM pl WHERE dropped IS NULL), " + BASE.format(k="series_id", t="r") + ", " + RUNS.format(k2="p.series_id", p="kp", t="r", on="b.series_id = p.series_id", onx="x.series_id = p.series_id", h=h)


def _shuffled(h: int) -> str:
    return (
        "WITH " + REGIMES + """, tr AS (SELECT series_id, 'true' AS ordering, row_index, coalesce(y, 0) AS y FROM s), sh AS (SELECT series_id, 'block-' || seed AS ordering, row_number() OVER (PARTITION BY series_id, seed ORDER BY sha256(seed || ':' || (row_index // 2)), row_index) - 1 AS row_index, y FROM tr, range(1, 6) q(seed)),
        al AS (SELECT * FROM tr UNION ALL SELECT * FROM sh), kp AS (SELECT series_id, ordering, row_index AS origin FROM al a WHERE row_index >= 32 AND row_index <= (SELECT count(*) FROM tr c WHERE c.series_id = a.series_id) - """
        + f"{h} AND (row_index - 32) % {h} = 0), "
        + BASE.format(k="series_id, ordering", t="al") + ", " + RUNS.format(k2="p.series_id, p.ordering", p="kp", t="al", on="b.series_id = p.series_id AND b.ordering = p.ordering", onx="x.series_id = p.series_id AND x.ordering = p.ordering", h=h)
    )


_LEVELS = "[" + ", ".join(f"{q}" for q in L.LEVELS) + "]"
BANDS = """rs AS (SELECT *, CASE WHEN lag(regime_start) OVER w = regime_start THEN y - lag(y) OVER w END AS res FROM {t} WINDOW w AS (PARTITION BY series_id ORDER BY row_index)),
  rl AS (SELECT p.series_id, p.origin, quantile_cont(rs.res, """ + _LEVELS + """) AS qs FROM kp p JOIN rs ON rs.series_id = p.series_id AND rs.row_index < p.origin AND rs.row_index >= p.origin - 512 JOIN {t} z ON z.series_id = p.series_id AND z.row_index = p.origin - 1 AND rs.regime_start = z.regime_start WHERE rs.res IS NOT NULL GROUP BY p.series_id, p.origin HAVING count(*) >= 8),
  rq AS (SELECT series_id, origin, unnest(""" + _LEVELS + """)::DOUBLE AS level, unnest(qs) AS q FROM rl),
  bd AS (SELECT p.series_id, p.origin, x.row_index - p.origin AS step, x.y, rq.level, b.persistence + rq.q AS q FROM kp p JOIN rq ON rq.series_id = p.series_id AND rq.origin = p.origin JOIN bs b ON b.series_id = p.series_id AND b.origin = p.origin JOIN {t} x ON x.series_id = p.series_id AND x.row_index >= p.origin AND x.row_index < p.origin + 4)"""
WHOLE = "WITH " + REGIMES.replace("SELECT series_id, week, CASE WHEN orders % 13 <> 0 THEN total END AS y", "SELECT series_id, week, CASE WHEN orders % 13 <> 0 THEN total ELSE 0 END AS y") + ", wh AS (SELECT series_id, row_index, y, 0 AS regime_start FROM s), kp AS (SELECT series_id, row_index AS origin FROM wh a WHERE row_index >= 32 AND row_index <= (SELECT count(*) FROM wh c WHERE c.series_id = a.series_id) - 4 AND (row_index - 32) % 4 = 0), " + BASE.format(k="series_id", t="wh")
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "backtest_plan": "WITH " + PLAN.format(h=4) + " SELECT series_id, origin, ctx_start, dropped FROM pl",
    "dropped_counts": "WITH " + PLAN.format(h=4) + " SELECT series_id, coalesce(dropped, 'kept') AS reason, count(*) AS n FROM pl GROUP BY ALL",
    "rolling_baselines": "WITH " + REGIMES + ", " + BASE.format(k="series_id", t="r") + " SELECT series_id, origin, round(persistence + slope, 6) AS local_drift, round(persistence, 6) AS persistence, round(rolling_mean, 6) AS rolling_mean, round(rolling_median, 6) AS rolling_median FROM bs",
    "backtest_mae": _runs(4) + " SELECT series_id, origin, forecaster, round(mae, 6) AS mae FROM rn",
    "forecaster_protocol": _runs(4) + " SELECT series_id, origin, round(mae, 6) AS mae FROM rn WHERE forecaster = 'rolling_mean'",
    "backtest_scores": _runs(4) + ", e AS (SELECT series_id, forecaster, count(*) AS n, avg(mae) AS m, median(mae) AS d FROM rn GROUP BY ALL) SELECT series_id, forecaster, n, round(m, 6) AS mae_mean, round(d, 6) AS mae_median, first_value(forecaster) OVER w AS best_baseline, round(1 - m / first_value(m) OVER w, 6) AS skill FROM e WINDOW w AS (PARTITION BY series_id ORDER BY m, forecaster)",
    "calibration": _runs(4) + ", " + BANDS.format(t="r") + " SELECT series_id, level, count(*) AS n, round(avg((y <= q)::INT), 6) AS coverage FROM bd GROUP BY ALL",
    "wqs": _runs(4) + ", " + BANDS.format(t="r") + " SELECT series_id, round(2 * sum(greatest(level * (y - q), (level - 1) * (y - q))) / (9 * (sum(abs(y)) / 9)), 6) AS wqs FROM bd GROUP BY 1",
    "tau": "WITH " + REGIMES + " SELECT series_id, CASE WHEN count(y) = 32 THEN round(quantile_cont(y, 0.8), 6) END AS tau FROM s WHERE row_index < 32 GROUP BY 1",
    "lead_time": WHOLE + ", " + BANDS.format(t="wh") + """, t AS (SELECT series_id, quantile_cont(y, 0.8) AS tau FROM wh WHERE row_index < 32 GROUP BY 1),
      w AS (SELECT series_id, origin, min(step) FILTER (y >= tau) AS c, min(step) FILTER (q >= tau) AS a FROM bd JOIN t USING (series_id) WHERE level = 0.8 GROUP BY ALL)
      SELECT series_id, count(*) AS eligible, count(*) FILTER (c IS NOT NULL AND a IS NOT NULL) AS hits, count(*) FILTER (c IS NOT NULL AND a IS NULL) AS misses, count(*) FILTER (c IS NULL AND a IS NOT NULL) AS false_alarms, count(*) FILTER (c IS NULL AND a IS NULL) AS quiet, median(c - a)::DOUBLE AS median_timing FROM w GROUP BY 1""",
    "block_shuffle": _shuffled(4) + " SELECT series_id, ordering, row_index, y FROM sh",
    "sentinel": _shuffled(4) + ", e AS (SELECT series_id, ordering, avg(mae) AS m FROM rn WHERE forecaster = 'persistence' GROUP BY ALL) SELECT p.series_id, bool_and(p.m > t.m) AS valid FROM e p JOIN e t ON t.series_id = p.series_id AND t.ordering = 'true' WHERE p.ordering <> 'true' GROUP BY 1",
    "decision": _shuffled(4) + """, e AS (SELECT series_id, ordering, forecaster, avg(mae) AS m FROM rn GROUP BY ALL), va AS (SELECT p.series_id, bool_and(p.m > t.m) AS valid FROM e p JOIN e t ON t.series_id = p.series_id AND t.ordering = 'true' WHERE p.ordering <> 'true' AND p.forecaster = 'persistence' AND t.forecaster = 'persistence' GROUP BY 1),
      be AS (SELECT series_id, arg_min(forecaster, (m, forecaster)) AS best, min(m) AS e_b FROM e WHERE ordering = 'true' AND forecaster <> 'rolling_mean' GROUP BY 1), ep AS (SELECT series_id, median(m) AS e_p FROM e WHERE ordering <> 'true' AND forecaster = 'rolling_mean' GROUP BY 1),
      tw AS (SELECT series_id, origin, median(mae) AS p FROM rn WHERE ordering <> 'true' AND forecaster = 'rolling_mean' GROUP BY ALL),
      ro AS (SELECT a.series_id, a.origin, a.mae AS m, b.mae AS b, tw.p, be.e_b, row_number() OVER (PARTITION BY a.series_id ORDER BY a.origin) > count(*) OVER (PARTITION BY a.series_id) // 2 AS late FROM rn a JOIN be USING (series_id) JOIN rn b ON b.series_id = a.series_id AND b.ordering = 'true' AND b.origin = a.origin AND b.forecaster = be.best LEFT JOIN tw ON tw.series_id = a.series_id AND tw.origin = a.origin WHERE a.ordering = 'true' AND a.forecaster = 'rolling_mean'),
      ha AS (SELECT series_id, bool_and(ok) AS both_ok FROM (SELECT series_id, late, avg(m) <= 0.9::DOUBLE * avg(p) AND avg((m < p)::INT) >= 0.6::DOUBLE AS ok FROM ro GROUP BY ALL) GROUP BY 1),
      t AS (SELECT series_id, count(*) AS n, avg(m) AS e_m, any_value(e_b) AS e_b, avg((m < b)::INT) AS w_mb, avg((m < p)::INT) AS w_mp FROM ro GROUP BY 1)
      SELECT series_id, n, round(e_m, 6) AS e_m, round(e_b, 6) AS e_b, round(e_p, 6) AS e_p, round(w_mb, 6) AS w_mb, round(w_mp, 6) AS w_mp, CASE WHEN n < 20 THEN 'not assessable' WHEN e_m > 0.9::DOUBLE * e_b OR w_mb < 0.6::DOUBLE THEN 'baseline sufficient' WHEN NOT valid THEN 'not assessable'
        WHEN e_m <= 0.9::DOUBLE * e_p AND w_mp >= 0.6::DOUBLE AND both_ok THEN 'temporal evolution' ELSE 'conditional prediction' END AS label FROM t JOIN ep USING (series_id) JOIN ha USING (series_id) JOIN va USING (series_id)""",
    "candidate_paired": _runs(4) + " SELECT series_id, count(*) AS n, round(median(x - y), 6) AS shift, round(avg((x < y)::INT), 6) AS share FROM (SELECT series_id, origin, max(mae) FILTER (forecaster = 'rolling_mean') AS x, max(mae) FILTER (forecaster = 'persistence') AS y FROM rn GROUP BY ALL) GROUP BY 1",
    "readiness": "WITH " + PLAN.format(h=4) + """, p AS (SELECT series_id, count(*) FILTER (dropped IS NULL) AS windows, count(*) FILTER (dropped LIKE 'missing%') AS missing, count(*) FILTER (dropped IN ('regime_too_short', 'changepoint_in_horizon')) AS cut FROM pl GROUP BY 1),
      v AS (SELECT series_id, count(DISTINCT y) AS vals, count(*) FILTER (changepoint) AS cps, count(y) FILTER (row_index < 32) AS head FROM r GROUP BY 1)
      SELECT series_id, windows, missing, cut, c.name AS "check", CASE c.name WHEN 'windows' THEN windows >= 20 WHEN 'missingness' THEN missing = 0 WHEN 'changepoints' THEN cps = 0 WHEN 'variation' THEN vals > 1 ELSE head = 32 END AS passes FROM p JOIN v USING (series_id) CROSS JOIN (VALUES ('windows'), ('missingness'), ('changepoints'), ('variation'), ('threshold')) c(name)""",
}
SQL["ablation_align"] = "SELECT series_id, origin, round(max(mae) FILTER (run = 'A'), 6) AS a, round(max(mae) FILTER (run = 'B'), 6) AS b, round(max(mae) FILTER (run = 'C'), 6) AS c FROM (" + " UNION ALL ".join(
    f"SELECT series_id, origin, '{n}' AS run, mae FROM ({_runs(h)} SELECT * FROM rn WHERE forecaster = 'rolling_mean')" for n, h in (("A", 1), ("B", 2), ("C", 4))
) + ") GROUP BY series_id, origin HAVING count(*) = 3"
