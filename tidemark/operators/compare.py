"""Comparative operators: cohorts, mid-rank percentiles, distributions and arm statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: thresholds and scales of the comparison rules
COHORT_MIN = 10
MAD_SCALE = 1.4826
POWER_Z = 2.8
RESOLUTION = 0.25
EXACT_MAX_N = 20

Cols = Sequence[str]


def cohort_members(df: DataFrame, ident: str, keys: Cols) -> DataFrame:
    """(ident, member): other rows that equal it in all keys; a row with an unknown key has no cohort.

    The pairs of a cohort grow with its square: use ``cohort_sizes`` or ``midrank`` for statistics.
    """
    full = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    a, b = full.select(F.col(ident), *keys), full.select(F.col(ident).alias("member"), *keys)
    return a.join(b, list(keys)).where(F.col(ident) != F.col("member")).select(ident, "member")


def cohort_sizes(df: DataFrame, ident: str, keys: Cols) -> DataFrame:
    """ident and n: how many others equal it in all keys, null where a key is unknown."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    sizes = df.where(known).groupBy(*keys).agg((F.count("*") - 1).alias("n"))
    return df.join(sizes, list(keys), "left").select(ident, "n")


def midrank(df: DataFrame, group: Cols, value: str, least: int = COHORT_MIN) -> DataFrame:
    """df with percentile: 100 (below + equal/2) / n within the group, of known values; null below ``least``.

    Values are counted first, so the windows run over distinct values, not over rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__same"))
    within = Window.partitionBy(*group)
    ranked = counts.withColumn("__n", F.sum("__same").over(within)).withColumn("__below", F.sum("__same").over(within.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__same"))
    place = F.when(F.col("__n") >= least, 100.0 * (F.col("__below") + F.col("__same") / 2) / F.col("__n"))
    return df.join(ranked.select(*group, value, place.alias("percentile")), [*group, value], "left")


def distribution(df: DataFrame, group: Cols, value: str) -> DataFrame:
    """n, unknown, median, scaled MAD, IQR, min and max of each group; spreads are null for fewer than two values."""
    base = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("unknown"), F.percentile(value, 0.5).alias("median"),
        (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    away = df.join(base.select(*group, "median"), list(group)).groupBy(*group).agg((F.percentile(F.abs(F.col(value) - F.col("median")), 0.5) * MAD_SCALE).alias("mad"))
    out = base.join(away, list(group))
    several = F.col("n") >= 2
    return out.select(*group, "n", "unknown", "median", F.when(several, F.col("mad")).alias("mad"), F.when(several, F.col("iqr")).alias("iqr"), "min", "max")


def pair_difference(df: DataFrame, ident: str, pairs: DataFrame) -> DataFrame:
    """For pairs(a, b): metric, a's and b's value, unit, and b - a where units agree and both are known."""
    left = df.select(F.col(ident).alias("a"), "metric", F.col("value").alias("value_a"), F.col("unit").alias("unit_a"))
    right = df.select(F.col(ident).alias("b"), "metric", F.col("value").alias("value_b"), F.col("unit").alias("unit_b"))
    one = pairs.join(left, "a").select("a", "b", "metric", "value_a", "unit_a")
    two = pairs.join(right, "b").select("a", "b", "metric", "value_b", "unit_b")
    return one.join(two, ["a", "b", "metric"], "full").withColumn("difference", F.when(F.col("unit_a") == F.col("unit_b"), F.col("value_b") - F.col("value_a")))


def arm_ranks(df: DataFrame, group: Cols, arm: str, value: str) -> DataFrame:
    """U of arm b, Cliff's delta and counts of two arms 'a' and 'b', from value counts instead of pairs."""
    known = df.where(F.col(value).isNotNull() & F.col(arm).isin("a", "b"))
    counts = known.groupBy(*group, value).agg(F.count_if(F.col(arm) == "a").alias("a"), F.count_if(F.col(arm) == "b").alias("b"))
    upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wins = F.col("b") * (F.sum("a").over(upto) - F.col("a") / 2)
    out = counts.withColumn("__wins", wins).groupBy(*group).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum("__wins").alias("u"))
    n = F.col("n_a") * F.col("n_b")
    return out.withColumn("cliffs_delta", F.try_divide(2 * F.col("u") - n, n.cast("double")))


def _kth_difference(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The k-th smallest (from 0) of all b - a without listing them: bisection over the order of floats."""
    as_int = lambda x: np.array([x]).view(np.int64)[0] if x >= 0 else -np.array([-x]).view(np.int64)[0]
    as_float = lambda i: float(np.array([i]).view(np.float64)[0]) if i >= 0 else -float(np.array([-i]).view(np.float64)[0])
    low, high = as_int(float(b[0] - a[-1])), as_int(float(b[-1] - a[0]))
    while low < high:
        mid = (int(low) + int(high)) >> 1
        if np.searchsorted(b, a + as_float(mid), "right").sum() >= k + 1:
            high = mid
        else:
            low = mid + 1
    return as_float(int(low))


def hodges_lehmann(df: DataFrame, group: Cols, arm: str, value: str) -> DataFrame:
    """The median of all differences b - a of two arms, without making the pairs.

    Arms are the repetitions of an experiment; each group's values are sorted together in one task.
    """

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf.loc[pdf[arm] == "a", value].to_numpy(float))
        b = np.sort(pdf.loc[pdf[arm] == "b", value].to_numpy(float))
        n = len(a) * len(b)
        out = pdf[list(group)].head(1).copy()
        out["hl_shift"] = None if not n else (_kth_difference(a, b, (n - 1) // 2) + _kth_difference(a, b, n // 2)) / 2
        return out

    kinds = dict(df.dtypes)
    known = df.where(F.col(value).isNotNull() & F.col(arm).isin("a", "b")).select(*group, arm, F.col(value).cast("double").alias(value))
    return known.groupBy(*group).applyInPandas(shift, ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", hl_shift double")


def rank_test_p(n_a: int, ranks2: list[int], observed2: int) -> float:
    """Exact two-sided p of a rank sum: the share of all choices of n_a doubled ranks as far from the mean.

    Choices are counted by their sums, one rank after the other.
    """
    total = sum(ranks2)
    ways = [[0] * (total + 1) for _ in range(n_a + 1)]
    ways[0][0] = 1
    for r in ranks2:
        for k in range(n_a, 0, -1):
            row, shorter = ways[k], ways[k - 1]
            for s in range(total, r - 1, -1):
                if shorter[s - r]:
                    row[s] += shorter[s - r]
    mean2 = n_a * total  # doubled mean times the pool's size
    n = len(ranks2)
    far = abs(observed2 * n - mean2)
    hit = sum(w for s, w in enumerate(ways[n_a]) if abs(s * n - mean2) >= far)
    return hit / sum(ways[n_a])


def mann_whitney(df: DataFrame, group: Cols, arm: str, value: str) -> DataFrame:
    """U and the exact p of two arms of at most EXACT_MAX_N values each; p is null beyond."""
    base = arm_ranks(df, group, arm, value)
    small = base.where((F.col("n_a") <= EXACT_MAX_N) & (F.col("n_b") <= EXACT_MAX_N) & (F.col("n_a") > 0) & (F.col("n_b") > 0)).select(*group)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        doubled = (2 * pdf[value].rank(method="average")).astype(int)
        mine = pdf[arm] == "a"
        out = pdf[list(group)].head(1).copy()
        out["p"] = rank_test_p(int(mine.sum()), doubled.tolist(), int(doubled[mine].sum()))
        return out

    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull() & F.col(arm).isin("a", "b")).join(small, list(group), "left_semi").select(*group, arm, value)
    p = rows.groupBy(*group).applyInPandas(test, ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", p double")
    return base.select(*group, "n_a", "n_b", "u").join(p, list(group), "left")


def resolution(n: Column, s_a: Column, s_b: Column, median: Column, shift: Column) -> dict[str, Column]:
    """Pooled spread, detectable difference, repetitions needed, demotion and label of a comparison."""
    s = F.sqrt((s_a * s_a + s_b * s_b) / 2)
    mdd = F.when(n >= 1, POWER_Z * s * F.sqrt(2.0 / n))
    needed = F.when(median != 0, F.ceil(2.0 * F.pow(POWER_Z * s / (RESOLUTION * F.abs(median)), 2)))
    label = F.when(shift.isNotNull() & mdd.isNotNull(), F.when(F.abs(shift) > mdd, "material environment effect").otherwise("not resolved at n"))
    return {"s": s, "mdd": mdd, "n_needed": needed, "demoted": mdd > RESOLUTION * F.abs(median), "label": label}


def auc_brier_spearman(df: DataFrame, group: Cols, label: str, score: str) -> DataFrame:
    """AUC with mid-ranks, Brier score and Spearman correlation of a 0/1 label and a score.

    Ranks come from value counts, so the windows run over distinct values.
    """
    counts = df.groupBy(*group, score).agg(F.sum(label).alias("ones"), F.count("*").alias("n"))
    within = Window.partitionBy(*group)
    upto = within.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.sum("n").over(upto) - (F.col("n") - 1) / 2
    rows = counts.withColumns({"rank": rank, "all_n": F.sum("n").over(within), "all_ones": F.sum("ones").over(within)})
    zeros = F.col("all_n") - F.col("all_ones")
    label_rank = lambda one: F.when(F.lit(one), zeros + (F.col("all_ones") + 1) / 2).otherwise((zeros + 1) / 2)
    mean = (F.col("all_n") + 1) / 2
    part = rows.groupBy(*group).agg(
        F.first("all_n").alias("n"), F.first("all_ones").alias("ones"), F.sum(F.col("ones") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("ones") * F.pow(1 - F.col(score), 2) + (F.col("n") - F.col("ones")) * F.pow(F.col(score), 2)).alias("loss"),
        F.sum(F.col("ones") * (F.col("rank") - mean) * (label_rank(True) - mean) + (F.col("n") - F.col("ones")) * (F.col("rank") - mean) * (label_rank(False) - mean)).alias("cov"),
        F.sum(F.col("n") * F.pow(F.col("rank") - mean, 2)).alias("var"),
        F.sum(F.col("ones") * F.pow(label_rank(True) - mean, 2) + (F.col("n") - F.col("ones")) * F.pow(label_rank(False) - mean, 2)).alias("label_var"),
    )
    pairs = F.col("ones") * (F.col("n") - F.col("ones"))
    return part.select(
        *group, "n", F.try_divide(F.col("rank_sum") - F.col("ones") * (F.col("ones") + 1) / 2, pairs.cast("double")).alias("auc"), (F.col("loss") / F.col("n")).alias("brier"),
        F.try_divide(F.col("cov"), F.sqrt(F.col("var") * F.col("label_var"))).alias("spearman"),
    )


def hash_fold(ident: Column, folds: int = 5) -> Column:
    """sha256 of the id modulo ``folds``, one of 3, 5 or 15: since 16 = 1 modulo these, the sum of its hex digits."""
    if folds not in (3, 5, 15):
        raise ValueError("folds must divide 15")
    digits = F.transform(F.filter(F.split(F.sha2(ident.cast("string"), 256), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % folds


def markov(df: DataFrame, key: Cols, order: Cols, state: str, fold: str, held: int, floor: int = 20) -> DataFrame:
    """Log-loss and accuracy of add-one smoothed next-state models with 0, 1 and 2 states of memory.

    Fitted on sessions outside the held fold. A context seen under ``floor`` times backs off to the shorter one. A model
    foretells its likeliest state (ties: the first by name). Transitions are counted first; longer memories are sums over windows
    that one dealing by the last state serves.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.select(*key, fold, F.col(state).alias("s"), F.lag(state).over(w).alias("p"), F.lag(state, 2).over(w).alias("pp")).where("p is not null")
    tri = rows.groupBy("pp", "p", "s").agg(F.count_if(F.col(fold) != held).alias("fit"), F.count_if(F.col(fold) == held).alias("test"))
    tri = tri.repartition("p")
    over = lambda c, *by: F.sum(c).over(Window.partitionBy(*by))
    likeliest = lambda c, *by: F.min(F.struct((-F.col(c)).alias("k"), "s")).over(Window.partitionBy(*by))["s"]
    tri = tri.withColumns({"n2": over("fit", "p", "pp"), "f1": over("fit", "p", "s"), "n1": over("fit", "p"), "g2": likeliest("fit", "p", "pp")}).withColumn("g1", likeliest("f1", "p"))
    single = tri.groupBy("s").agg(F.sum("fit").alias("f0"))
    whole = single.agg(F.sum("f0").alias("n0"), F.count("*").alias("v"), F.min(F.struct((-F.col("f0")).alias("k"), "s"))["s"].alias("g0"))  # one row
    j = tri.join(single, "s").crossJoin(F.broadcast(whole))
    known1, known2 = F.col("n1") >= floor, F.col("pp").isNotNull() & (F.col("n2") >= floor)
    p0 = (F.col("f0") + 1) / (F.col("n0") + F.col("v"))
    p1 = F.when(known1, (F.col("f1") + 1) / (F.col("n1") + F.col("v"))).otherwise(p0)
    p2 = F.when(known2, (F.col("fit") + 1) / (F.col("n2") + F.col("v"))).otherwise(p1)
    g1 = F.when(known1, F.col("g1")).otherwise(F.col("g0"))
    g2 = F.when(known2, F.col("g2")).otherwise(g1)
    losses = [F.try_divide(-F.sum(F.col("test") * F.ln(p)), F.sum("test")).alias(f"loss{k}") for k, p in enumerate((p0, p1, p2))]
    right = [F.try_divide(F.sum(F.when(F.col("s") == g, F.col("test")).otherwise(0)).cast("double"), F.sum("test")).alias(f"accuracy{k}") for k, g in enumerate((F.col("g0"), g1, g2))]
    return j.agg(F.sum("test").alias("n"), *losses, *right)
