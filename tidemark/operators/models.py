"""Linear models by distributed sums: each fit is a few small aggregates, no rows come to the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """df with features at mean 0 and deviation 1 (0 where constant), and the means and deviations."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in features}
    return df.withColumns({c: (F.col(c) - m) / s if s else F.lit(0.0) for c, (m, s) in scale.items()}), scale


def _gram(df: DataFrame, features: Sequence[str], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray]:
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*[F.sum(weight * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(target * x[i]).alias(f"t{i}") for i in range(n)]).first()
    g = np.zeros((n, n))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, np.array([row[f"t{i}"] or 0.0 for i in range(n)])


def ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> np.ndarray:
    """Intercept (not penalised) and coefficients."""
    g, t = _gram(df, features, F.lit(1.0), F.col(target).cast("double"))
    return np.linalg.solve(g + penalty * np.diag([0.0] + [1.0] * len(features)), t)


def linear(features: Sequence[str], coefficients: np.ndarray) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, w in zip(features, coefficients[1:], strict=True):
        out = out + F.col(c) * float(w)
    return out


def logistic(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and coefficients by Newton steps, each one aggregate over df."""
    w = np.zeros(len(features) + 1)
    shrink = penalty * np.diag([0.0] + [1.0] * len(features))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-linear(features, w)))
        g, t = _gram(df, features, p * (1 - p), F.col(target).cast("double") - p)
        step = np.linalg.solve(g + shrink + 1e-9 * np.eye(len(w)), t - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
