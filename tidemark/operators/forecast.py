"""Rolling-origin backtests of naive forecasters, placebo orders and the decision rule.

Everything a window needs is a bounded frame behind its origin or ahead of it, so a backtest is a few window
functions over the series and no window is ever copied out. Series: series_id, row_index, y, regime_start,
changepoint; an ``ordering`` key keeps true and shuffled orders apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the pre-registered constants of the backtest and the decision
DELTA = 0.10
WIN_SHARE = 0.60
K_MIN = 20
C_MIN = 32
BASELINE_WINDOW = 8
MAX_CONTEXT = 512
PLACEBO_SEEDS = 5
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BASELINES = ("local_drift", "persistence", "rolling_mean", "rolling_median")

KEY = ["series_id", "ordering"]


def _over(low: int, high: int):
    return Window.partitionBy(*KEY).orderBy("row_index").rowsBetween(low, high)


def sorted_quantile(values: Column, level: float) -> Column:
    """Linear interpolation on a sorted array, as by percentile(); null for an empty one."""
    n = F.size(values)
    at = (n - 1) * F.lit(float(level))
    low = F.greatest(F.floor(at), F.lit(0)).cast("int")
    a, b = F.try_element_at(values, low + 1), F.try_element_at(values, F.greatest(F.least(low + 2, n), F.lit(1)))
    return F.when(n > 0, a + (b - a) * (at - low))


def plan(series: DataFrame, horizon: int, c_min: int = C_MIN) -> DataFrame:
    """Every origin c_min, c_min+H, ... with its context start and why it is dropped, if it is.

    Reasons in this order: regime_too_short, changepoint_in_horizon, missing_context_value,
    missing_actual_value.
    """
    holes = F.sum(F.col("y").isNull().cast("int")).over(Window.partitionBy(*KEY).orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = series.withColumns({"__n": F.count("*").over(Window.partitionBy(*KEY)), "__holes": holes})
    rows = rows.withColumn("ctx_start", F.greatest("regime_start", F.col("row_index") - MAX_CONTEXT))
    # holes before the context: kept in an array would grow, so they are looked up by row number
    at = rows.select(*KEY, (F.col("row_index") + 1).alias("ctx_start"), F.col("__holes").alias("__before"))
    origin = rows.where((F.col("row_index") >= c_min) & (F.col("row_index") <= F.col("__n") - horizon) & ((F.col("row_index") - c_min) % horizon == 0))
    ahead = rows.select(*KEY, F.col("row_index").alias("__row"), F.coalesce(F.max("changepoint").over(_over(1, horizon - 1)) if horizon > 1 else F.lit(False), F.lit(False)).alias("__cut"), F.max(F.col("y").isNull()).over(_over(0, horizon - 1)).alias("__gap"), (F.col("__holes") - F.col("y").isNull().cast("int")).alias("__upto"))
    j = origin.join(ahead, [*(origin[k].eqNullSafe(ahead[k]) for k in KEY), origin["row_index"] == ahead["__row"]]).drop(*(ahead[k] for k in KEY))
    j = j.join(at, [*KEY, "ctx_start"], "left")
    reason = (
        F.when(F.col("row_index") - F.col("ctx_start") < c_min, "regime_too_short").when(F.col("__cut"), "changepoint_in_horizon")
        .when(F.col("__upto") - F.coalesce("__before", F.lit(0)) > 0, "missing_context_value").when(F.col("__gap"), "missing_actual_value")
    )
    return j.select(*KEY, F.col("row_index").alias("origin"), "ctx_start", reason.alias("dropped"))


def forecasts(series: DataFrame, horizon: int) -> DataFrame:
    """For each row as an origin: actual block, last context value and the baselines' points (one array a forecaster)."""
    w = BASELINE_WINDOW
    back = F.array_sort(F.collect_list("y").over(_over(-w, -1)))
    order = Window.partitionBy(*KEY).orderBy("row_index")
    flat = lambda c: F.array_repeat(c, horizon)
    last, far = F.lag("y", 1).over(order), F.lag("y", w + 1).over(order)
    rows = series.withColumns({
        "last_context": last, "__mean": F.avg("y").over(_over(-w, -1)), "__sorted": back, "__slope": (last - far) / w,
        "actual": F.collect_list("y").over(_over(0, horizon - 1)),
    })
    return rows.select(
        *KEY, F.col("row_index").alias("origin"), "actual", "last_context", flat("last_context").alias("persistence"), flat("__mean").alias("rolling_mean"), flat(sorted_quantile(F.col("__sorted"), 0.5)).alias("rolling_median"),
        F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.col("last_context") + F.col("__slope") * i).alias("local_drift"),
    )


def mae(actual: Column, point: Column) -> Column:
    """To six decimals, so that the noise of summation decides no win."""
    return F.round(F.aggregate(F.zip_with(actual, point, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(actual), 6)


def backtest(series: DataFrame, horizon: int, c_min: int = C_MIN) -> DataFrame:
    """One row per kept window and baseline: actual, point and mae."""
    kept = plan(series, horizon, c_min).where("dropped is null").select(*KEY, "origin")
    wide = kept.join(forecasts(series, horizon), [*KEY, "origin"])
    long = wide.select(*KEY, "origin", "actual", "last_context", F.explode(F.map_from_arrays(F.lit(list(BASELINES)), F.array(*BASELINES))).alias("forecaster", "point"))
    return long.withColumn("mae", mae(F.col("actual"), F.col("point")))


def scores(runs: DataFrame) -> DataFrame:
    """Windows, mean and median MAE, and skill against the best baseline (the first by name among equals)."""
    each = runs.groupBy(*KEY, "forecaster").agg(F.count("*").alias("n"), F.avg("mae").alias("mae_mean"), F.percentile("mae", 0.5).alias("mae_median"))
    within = Window.partitionBy(*KEY)
    best = F.min(F.struct("mae_mean", "forecaster")).over(within)
    return each.withColumn("best_baseline", best["forecaster"]).withColumn("skill", F.when(best["mae_mean"] != 0, 1 - F.col("mae_mean") / best["mae_mean"]))


def residual_quantiles(series: DataFrame, horizon: int = 1, c_min: int = C_MIN) -> DataFrame:
    """Nine quantiles of persistence's one-step residuals inside each context (at least eight), by origin.

    Only at rows that can be origins of this horizon (see ``plan``) are the residuals sorted.
    """
    order = Window.partitionBy(*KEY).orderBy("row_index")
    inside = Window.partitionBy(*KEY, "regime_start").orderBy("row_index").rowsBetween(-(MAX_CONTEXT - 1), 0)
    was = F.when(F.lag("regime_start").over(order) == F.col("regime_start"), F.lag("y").over(order))
    rows = series.withColumn("__r", F.col("y") - was)
    at = F.col("row_index") + 1
    rows = rows.withColumn("__all", F.collect_list("__r").over(inside)).where((at >= c_min) & ((at - c_min) % horizon == 0)).withColumn("__all", F.array_sort("__all"))
    usable = F.when(F.size("__all") >= BASELINE_WINDOW, F.col("__all"))
    return rows.select(*KEY, (F.col("row_index") + 1).alias("origin"), F.col("regime_start").alias("__regime"), F.array(*(sorted_quantile(usable, q) for q in LEVELS)).alias("residuals")).where("residuals[0] is not null")


def banded(series: DataFrame, horizon: int) -> DataFrame:
    """Persistence's windows with their quantile bands: rows of (origin, step, y, level, q)."""
    runs = backtest(series, horizon).where("forecaster = 'persistence'")
    j = runs.join(residual_quantiles(series, horizon), [*KEY, "origin"])
    steps = j.select(*KEY, "origin", "last_context", "residuals", F.posexplode("actual").alias("step", "y"))
    return steps.select(*KEY, "origin", "step", "y", "last_context", F.posexplode("residuals").alias("i", "r")).select(*KEY, "origin", "step", "y", F.element_at(F.lit(list(LEVELS)), F.col("i") + 1).alias("level"), (F.col("last_context") + F.col("r")).alias("q"))


def calibration(bands: DataFrame) -> DataFrame:
    """Coverage of each quantile level."""
    return bands.groupBy(*KEY, "level").agg(F.count("*").alias("n"), F.avg((F.col("y") <= F.col("q")).cast("double")).alias("coverage"))


def pinball(y: Column, q: Column, level: Column) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def weighted_quantile_score(bands: DataFrame) -> DataFrame:
    """2 sum(pinball) / (levels * sum |y|); null where all y are 0."""
    total = bands.groupBy(*KEY).agg(F.sum(pinball(F.col("y"), F.col("q"), F.col("level"))).alias("p"), (F.sum(F.abs("y")) / len(LEVELS)).alias("a"))
    return total.select(*KEY, F.when(F.col("a") != 0, 2 * F.col("p") / (len(LEVELS) * F.col("a"))).alias("wqs"))


def threshold(series: DataFrame, c_min: int = C_MIN) -> DataFrame:
    """tau: the 0.8 quantile of the first c_min rows, null if one of them is unknown."""
    head = series.where(F.col("row_index") < c_min)
    return head.groupBy(*KEY).agg(F.when((F.count("y") == F.count("*")) & (F.count("*") == c_min), F.percentile("y", 0.8)).alias("tau"))


def lead_times(bands: DataFrame, tau: DataFrame) -> DataFrame:
    """Windows by whether the actual crossed tau and the 0.8 quantile alarmed, with mean lead.

    Windows whose last context value is over tau already aren't eligible.
    """
    b = bands.where("level = 0.8").join(tau, KEY).where("tau is not null")
    w = b.groupBy(*KEY, "origin").agg(F.min(F.when(F.col("y") >= F.col("tau"), F.col("step"))).alias("crossed"), F.min(F.when(F.col("q") >= F.col("tau"), F.col("step"))).alias("alarmed"))
    hit = F.col("crossed").isNotNull() & F.col("alarmed").isNotNull()
    return w.groupBy(*KEY).agg(
        F.count("*").alias("eligible"), F.count_if(hit).alias("hits"), F.count_if(F.col("crossed").isNotNull() & F.col("alarmed").isNull()).alias("misses"), F.count_if(F.col("crossed").isNull() & F.col("alarmed").isNotNull()).alias("false_alarms"),
        F.count_if(F.col("crossed").isNull() & F.col("alarmed").isNull()).alias("quiet"), F.percentile(F.when(hit, F.col("crossed") - F.col("alarmed")), 0.5).alias("median_timing"),
    )


def block_shuffle(series: DataFrame, block: int, seeds: int = PLACEBO_SEEDS) -> DataFrame:
    """Copies of the series whose blocks of rows are in the order of sha256(seed, block); row numbers are new.

    The multiset of rows stays. Regimes are those of the true order, by row number.
    """
    seeded = series.crossJoin(F.broadcast(series.sparkSession.range(1, seeds + 1).withColumnRenamed("id", "seed"))).withColumn("ordering", F.concat(F.lit("block-"), F.col("seed").cast("string")))
    blocked = seeded.withColumn("__h", F.sha2(F.concat_ws(":", F.col("seed").cast("string"), F.floor(F.col("row_index") / block).cast("string")), 256))
    placed = blocked.withColumn("__new", (F.row_number().over(Window.partitionBy(*KEY).orderBy("__h", "row_index")) - 1).cast("long"))
    return placed.select(*KEY, F.col("__new").alias("row_index"), "y")


def with_true_regimes(shuffled: DataFrame, series: DataFrame) -> DataFrame:
    regimes = series.select("series_id", "row_index", "regime_start", "changepoint")
    return shuffled.join(regimes, ["series_id", "row_index"])


def sentinel(true: DataFrame, placebo: DataFrame) -> DataFrame:
    """Whether persistence is strictly worse under every placebo than in true order."""
    t = true.where("forecaster = 'persistence'").select("series_id", F.col("mae_mean").alias("true_mae"))
    p = placebo.where("forecaster = 'persistence'")
    return p.join(t, "series_id").groupBy("series_id").agg(F.bool_and(F.col("mae_mean") > F.col("true_mae")).alias("valid"))


def decide(true_runs: DataFrame, placebo_runs: DataFrame, valid: DataFrame | None, model: str) -> DataFrame:
    """The label of a model of each series: not assessable, baseline sufficient, temporal evolution or conditional prediction.

    Baselines are the other forecasters. Ties are no wins. Both halves of the ordered origins have to
    agree before a result counts as temporal. valid: series_id, valid; None takes it from the runs' own persistence (see ``sentinel``).

    Runs are dealt by series once, true and placebo ones together, and all that follows stays within a series' partition.
    """
    columns = ["series_id", "ordering", "origin", "forecaster", "mae"]
    runs = true_runs.select(*columns, F.lit(True).alias("own")).unionByName(placebo_runs.select(*columns, F.lit(False).alias("own"))).repartition("series_id")
    runs = runs.withColumn("e", F.avg("mae").over(Window.partitionBy("series_id", "own", "ordering", "forecaster")))
    own, mine = F.col("own"), F.col("forecaster") == model
    of = lambda where, c: F.when(where, F.col(c))
    # of each origin: the model's error, the best baseline's (by its mean, then its name), and the median placebo's
    rows = runs.groupBy("series_id", "origin").agg(
        F.max(of(own & mine, "mae")).alias("m"), F.min(F.when(own & ~mine, F.struct("e", "forecaster", "mae"))).alias("best"), F.percentile(of(~own & mine, "mae"), 0.5).alias("p")
    ).where("m is not null and best is not null")
    within = Window.partitionBy("series_id")
    rows = rows.withColumn("late", F.row_number().over(within.orderBy("origin")) > F.floor(F.count("*").over(within) / 2)).withColumn("b", F.col("best.mae"))
    win = lambda a, b, where=F.lit(True): F.avg(F.when(F.col(b).isNotNull() & where, (F.col(a) < F.col(b)).cast("double")))
    halves = []
    for half in (F.col("late"), ~F.col("late")):
        agrees = (F.avg(of(half, "m")) <= (1 - DELTA) * F.avg(of(half, "p"))) & (win("m", "p", half) >= WIN_SHARE)
        halves.append((F.count_if(half) == 0) | F.coalesce(agrees, F.lit(False)))
    t = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("m").alias("e_m"), F.first("best.e").alias("e_b"), win("m", "b").alias("w_mb"), win("m", "p").alias("w_mp"), (halves[0] & halves[1]).alias("both")
    )
    seeds = F.collect_set(F.when(~own & mine, F.struct("ordering", "e")))  # one a seed
    steady = F.col("forecaster") == "persistence"
    whole = runs.groupBy("series_id").agg(F.array_sort(F.transform(seeds, lambda x: x["e"])).alias("seeds"), (F.min(of(~own & steady, "e")) > F.max(of(own & steady, "e"))).alias("steady"))
    t = t.join(whole.select("series_id", sorted_quantile(F.col("seeds"), 0.5).alias("e_p"), "steady"), "series_id", "left")
    t = t.withColumn("valid", F.col("steady")) if valid is None else t.join(valid, "series_id", "left")
    label = (
        F.when(F.col("n") < K_MIN, "not assessable")
        .when((F.col("e_m") > (1 - DELTA) * F.col("e_b")) | (F.col("w_mb") < WIN_SHARE), "baseline sufficient")
        .when(F.col("e_p").isNull() | ~F.coalesce("valid", F.lit(False)), "not assessable")
        .when((F.col("e_m") <= (1 - DELTA) * F.col("e_p")) & (F.col("w_mp") >= WIN_SHARE) & F.col("both"), "temporal evolution")
        .otherwise("conditional prediction")
    )
    return t.select("series_id", "n", "e_m", "e_b", "e_p", "w_mb", "w_mp", label.alias("label"))


def readiness(series: DataFrame, horizon: int, c_min: int = C_MIN, k_min: int = K_MIN) -> DataFrame:
    """Checks before a forecast: windows, missing rows, changepoints, variation and a threshold."""
    p = plan(series, horizon, c_min).groupBy(*KEY).agg(F.count_if(F.col("dropped").isNull()).alias("windows"), F.count_if(F.col("dropped").like("missing%")).alias("missing"), F.count_if(F.col("dropped").isin("regime_too_short", "changepoint_in_horizon")).alias("cut"))
    v = series.groupBy(*KEY).agg(F.countDistinct("y").alias("values"), F.count_if(F.col("changepoint")).alias("changepoints"))
    j = p.join(v, KEY).join(threshold(series, c_min), KEY, "left")
    checks = {"windows": F.col("windows") >= k_min, "missingness": F.col("missing") == 0, "changepoints": F.col("changepoints") == 0, "variation": F.col("values") > 1, "threshold": F.col("tau").isNotNull()}
    return j.select(*KEY, "windows", "missing", "cut", F.explode(F.map_from_arrays(F.lit(list(checks)), F.array(*checks.values()))).alias("check", "passes"))
