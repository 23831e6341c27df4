"""The forecaster protocol: any function of a window, run at every kept origin of every series.

A window holds what is known before its origin and nothing else: the target's context, covariates beside it, and, if they are asked for,
covariates that are known at the origin too, with their last value repeated to the horizon's end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import C_MIN, KEY, MAX_CONTEXT, plan

BLOCK = 4096  # origins of a task, at most; the rows before and behind them go with it


@dataclass(frozen=True)
class Window:
    """context: the target from ctx_start to the row before the origin. past: covariates of the same rows. future: covariates of these rows, the origin, and as many
    times its value again as the horizon goes on."""

    series_id: object
    ordering: str
    origin: int
    ctx_start: int
    horizon: int
    context: np.ndarray
    past: Mapping[str, np.ndarray] = field(default_factory=dict)
    future: Mapping[str, np.ndarray] = field(default_factory=dict)


class Forecaster(Protocol):
    """One method: as many finite numbers as the window's horizon."""

    name: str

    def forecast(self, window: Window) -> Sequence[float]: ...


@dataclass(frozen=True)
class Named:
    """A plain function as a forecaster."""

    name: str
    function: Callable[[Window], Sequence[float]]

    def forecast(self, window: Window) -> Sequence[float]:
        return self.function(window)


def _checked(forecaster: Forecaster, window: Window) -> tuple[list[float] | None, str | None]:
    """The points, or why there are none: an error's name, wrong_length or not_finite."""
    try:
        points = [float(x) for x in forecaster.forecast(window)]
    except Exception as e:  # a forecaster's own failure is a result, and costs its window only
        return None, type(e).__name__
    if len(points) != window.horizon:
        return None, "wrong_length"
    return (points, None) if np.isfinite(points).all() else (None, "not_finite")


def run_forecaster(series: DataFrame, horizon: int, forecaster: Forecaster, c_min: int = C_MIN, past: Sequence[str] = (), future: Sequence[str] = ()) -> DataFrame:
    """series_id, ordering, origin, actual, last_context, forecaster, point, mae, fault: one row for each kept window, as ``backtest`` has them.

    point and mae are null where fault says why. past and future name further columns of series, numbers without gaps. Origins are dealt in
    blocks with the rows that they need, so a series of any length is many tasks.
    """
    kept = plan(series.select(*KEY, "row_index", "y", "regime_start", "changepoint"), horizon, c_min).where("dropped is null").select(*KEY, "origin", "ctx_start")
    names = list(dict.fromkeys([*past, *future]))
    rows = series.select(*KEY, "row_index", F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in names))
    reach = F.sequence(F.floor(F.greatest(F.col("row_index") - horizon + 1, F.lit(0)) / BLOCK), F.floor((F.col("row_index") + MAX_CONTEXT) / BLOCK))
    rows = rows.withColumn("block", F.explode(reach)).withColumnsRenamed({k: f"r_{k}" for k in (*KEY, "block")})
    kept = kept.withColumn("block", F.floor(F.col("origin") / BLOCK))

    def run(origins: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("row_index")
        first = held.column("row_index")[0].as_py() if held.num_rows else 0
        values = {c: held.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", *names)}
        out = {"actual": [], "last_context": [], "point": [], "mae": [], "fault": []}
        at, starts = origins.column("origin").to_pylist(), origins.column("ctx_start").to_pylist()
        for k, (o, s) in enumerate(zip(at, starts, strict=True)):
            cut = lambda c, a, b: values[c][a - first : b - first]
            padded = {c: np.append(cut(c, s, o + 1), np.repeat(cut(c, o, o + 1), horizon - 1)) for c in future}
            window = Window(origins.column("series_id")[k].as_py(), origins.column("ordering")[k].as_py(), o, s, horizon, cut("y", s, o).copy(), {c: cut(c, s, o).copy() for c in past}, padded)
            point, fault = _checked(forecaster, window)
            actual = cut("y", o, o + horizon).tolist()
            out["actual"].append(actual)
            out["last_context"].append(float(window.context[-1]))
            out["point"].append(point)
            out["mae"].append(None if point is None else round(sum(abs(a - b) for a, b in zip(actual, point, strict=True)) / horizon, 6))
            out["fault"].append(fault)
        kinds = {"actual": pa.list_(pa.float64()), "last_context": pa.float64(), "point": pa.list_(pa.float64()), "mae": pa.float64(), "fault": pa.string()}
        names_ = pa.array([forecaster.name] * len(at), pa.string())
        return pa.table({**{c: origins.column(c) for c in (*KEY, "origin")}, "forecaster": names_, **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "origin")) + ", forecaster string, actual array<double>, last_context double, point array<double>, mae double, fault string"
    return kept.groupBy(*KEY, "block").cogroup(rows.groupBy(*(f"r_{k}" for k in KEY), "r_block")).applyInArrow(lambda a, b: run(a, b), schema)


def paired(conditioned: DataFrame, plain: DataFrame) -> DataFrame:
    """(series_id, ordering, n, shift, wins) of two runs over the origins that both have: the median of the paired differences of mae, and the share of origins that the first
    wins; ties are losses."""
    a = conditioned.where("mae is not null").select(*KEY, "origin", F.col("mae").alias("__a"))
    b = plain.where("mae is not null").select(*KEY, "origin", F.col("mae").alias("__b"))
    j = a.join(b, [*KEY, "origin"])
    return j.groupBy(*KEY).agg(F.count("*").alias("n"), F.percentile(F.col("__a") - F.col("__b"), 0.5).alias("shift"), F.avg((F.col("__a") < F.col("__b")).cast("double")).alias("wins"))
