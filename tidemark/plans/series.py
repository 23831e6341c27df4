"""Logical clocks: series rows on the attempt and change clocks, regimes, policies and column reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.nulls import distinct_three, sum_known
from ..operators.ordered import changed, timeline
from .staging import table

SERIES, ROW = ["series_id"], ["row_index"]


def weekly_series(spark, d) -> DataFrame:
    """series_id, row_index, week, y, orders, env: a priority's weekly revenue.

    A week of a multiple of 13 orders is unknown. env changes every three years, which starts a regime.
    """
    o = table(spark, d, "orders").withColumn("week", F.to_date(F.date_trunc("week", "o_orderdate")))
    g = o.groupBy(F.col("o_orderpriority").alias("series_id"), "week").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("orders"))
    g = g.select("series_id", "week", F.when(F.col("orders") % 13 != 0, F.col("total")).alias("y"), "orders", F.floor(F.year("week") / 3).cast("string").alias("env"))
    return g.withColumn("row_index", (F.row_number().over(timeline(SERIES, ["week"])) - 1).cast("long"))


def with_regimes(series: DataFrame) -> DataFrame:
    """series with regime_start: the row where the environment in force began."""
    flag = changed(F.col("env"), SERIES, ROW)
    return series.withColumn("changepoint", F.coalesce(flag == 1, F.lit(False))).withColumn(
        "regime_start", F.coalesce(F.max(F.when(F.col("changepoint"), F.col("row_index"))).over(timeline(SERIES, ROW).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("long"))
    )


def regime_cut(series: DataFrame, marks: DataFrame, after: bool) -> DataFrame:
    """Rows before (or from) each series' first row that closed at or after its mark, numbered anew. marks: series_id, at."""
    first = series.join(marks, "series_id").where("week >= at").groupBy("series_id").agg(F.min("row_index").alias("cut"))
    kept = series.join(first, "series_id").where("row_index >= cut" if after else "row_index < cut")
    return kept.withColumn("row_index", (F.row_number().over(timeline(SERIES, ROW)) - 1).cast("long")).drop("cut")


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: known and unknown rows, and its coverage word; an empty column is unavailable."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    long = counts.unpivot(["n"], columns, "column", "known")
    word = F.when(F.col("known") == 0, "unavailable").when(F.col("known") < F.col("n"), "partial").otherwise("observed")
    return long.select("column", "known", (F.col("n") - F.col("known")).alias("unknown"), word.alias("coverage"))


def retained(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns are all known, numbered anew; ``was`` is the old number."""
    kept = df.dropna(subset=columns).withColumnRenamed("row_index", "was")
    return kept.withColumn("row_index", (F.row_number().over(timeline(key, ["was"])) - 1).cast("long"))


def q_attempt_clock(spark, d):
    """One row per order of a customer: its aggregates over lines, on the attempt clock."""
    o = table(spark, d, "orders")
    l = table(spark, d, "lineitem").withColumn("part", F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey"))).withColumn("cents", F.when(F.col("l_linenumber") != 7, F.round(F.col("l_extendedprice") * 100).cast("long")))
    any_ = F.lit(True)
    agg = l.groupBy("l_orderkey").agg(F.count("*").alias("lines"), sum_known(any_, "cents").alias("cents"), distinct_three(any_, "part").alias("parts"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("last_status"), F.count_if(F.col("l_returnflag") == "R").alias("failed_reviews"))
    j = o.join(agg, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    env = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return j.select("o_custkey", "o_orderkey", (F.row_number().over(timeline(["o_custkey"], ["o_orderdate", "o_orderkey"])) - 1).cast("long").alias("row_index"), F.coalesce("lines", F.lit(0)).alias("lines"), "cents", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"), "last_status", F.coalesce("failed_reviews", F.lit(0)).alias("failed_reviews"), changed(env, ["o_custkey"], ["o_orderdate", "o_orderkey"]).alias("env_changed"))


def q_weekly_series(spark, d):
    return weekly_series(spark, d).select("series_id", "row_index", "week", "y", "orders", "env")


def q_regime_starts(spark, d):
    return with_regimes(weekly_series(spark, d)).select("series_id", "row_index", "changepoint", "regime_start")


def q_regime_cut(spark, d):
    s = weekly_series(spark, d)
    marks = s.groupBy("series_id").agg(F.expr("min(week) + interval 400 days").alias("at"))
    return regime_cut(s, marks, after=True).select("series_id", "row_index", "week", "y")


def q_column_report(spark, d):
    return column_report(weekly_series(spark, d).withColumn("never", F.lit(None).cast("double")), ["y", "orders", "env", "never"])


def q_retained_rows(spark, d):
    return retained(weekly_series(spark, d), SERIES, ["y"]).select("series_id", "row_index", "was", "y")


def q_excluded_rows(spark, d):
    """Rows that the exclude policy drops, with the reason."""
    s = weekly_series(spark, d)
    kept = retained(s, SERIES, ["y"]).select("series_id", F.col("was").alias("row_index"))
    return s.join(kept, ["series_id", "row_index"], "left_anti").select("series_id", "row_index", F.lit("y is unknown").alias("reason"))


WEEKLY = """g AS (SELECT o_orderpriority AS series_id, date_trunc('week', o_orderdate)::DATE AS week, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*) AS orders FROM orders GROUP BY ALL),
  s AS (SELECT series_id, week, CASE WHEN orders % 13 <> 0 THEN total END AS y, orders, (year(week) // 3)::VARCHAR AS env, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS row_index FROM g)"""
REGIMES = WEEKLY + """, rc AS (SELECT *, coalesce(env <> lag(env) OVER (PARTITION BY series_id ORDER BY row_index), false) AS changepoint FROM s),
  r AS (SELECT *, coalesce(max(CASE WHEN changepoint THEN row_index END) OVER (PARTITION BY series_id ORDER BY row_index), 0) AS regime_start FROM rc)"""
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
SQL = {
    "attempt_clock": """WITH l AS (SELECT l_orderkey, count(*) AS lines, (sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_linenumber <> 7))::BIGINT AS cents, nullif(count(DISTINCT l_partkey) FILTER (l_partkey % 10 <> 0), 0) AS parts,
      arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS last_status, count(*) FILTER (l_returnflag = 'R') AS failed_reviews FROM lineitem GROUP BY 1),
      o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS env FROM orders)
      SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS row_index, coalesce(lines, 0) AS lines, cents, coalesce(parts, 0) AS parts, last_status, coalesce(failed_reviews, 0) AS failed_reviews,
      CASE WHEN env IS NOT NULL THEN CASE WHEN lag(env) OVER w IS NULL OR lag(env) OVER w = env THEN 0 ELSE 1 END END AS env_changed FROM o LEFT JOIN l ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "weekly_series": f"WITH {WEEKLY} SELECT series_id, row_index, week, y, orders, env FROM s",
    "regime_starts": f"WITH {REGIMES} SELECT series_id, row_index, changepoint, regime_start FROM r",
    "regime_cut": f"WITH {WEEKLY}, c AS (SELECT series_id, (SELECT min(b.row_index) FROM s b WHERE b.series_id = a.series_id AND b.week >= min(a.week) + INTERVAL 400 DAY) AS k FROM s a GROUP BY series_id) SELECT series_id, row_index - k AS row_index, week, y FROM s JOIN c USING (series_id) WHERE row_index >= k",
    "column_report": f"WITH {WEEKLY}, n AS (SELECT count(*) AS n, count(y) AS y, count(orders) AS o, count(env) AS e FROM s), u AS (SELECT 'y' AS \"column\", y AS known, n FROM n UNION ALL SELECT 'orders', o, n FROM n UNION ALL SELECT 'env', e, n FROM n UNION ALL SELECT 'never', 0, n FROM n) SELECT \"column\", known, n - known AS unknown, CASE WHEN known = 0 THEN 'unavailable' WHEN known < n THEN 'partial' ELSE 'observed' END AS coverage FROM u",
    "retained_rows": f"WITH {WEEKLY} SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY row_index) - 1 AS row_index, row_index AS was, y FROM s WHERE y IS NOT NULL",
    "excluded_rows": f"WITH {WEEKLY} SELECT series_id, row_index, 'y is unknown' AS reason FROM s WHERE y IS NULL",
}
