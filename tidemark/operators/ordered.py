"""Ordered operators: carried state, islands and the request clock, as window functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Cols = Sequence[str]


def timeline(key: Cols, order: Cols) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def upto(key: Cols, order: Cols) -> WindowSpec:
    """All rows up to and with the current one."""
    return timeline(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: Cols, order: Cols) -> WindowSpec:
    """All rows before the current one."""
    return timeline(key, order).rowsBetween(Window.unboundedPreceding, -1)


def last(n: int, key: Cols, order: Cols) -> WindowSpec:
    """The n rows before the current one."""
    return timeline(key, order).rowsBetween(-n, -1)


def carried(setting: Column, value: Column, over: WindowSpec) -> Column:
    """The value of the last row that sets it; a row may set it to null, so the value travels in a struct."""
    return F.last(F.when(setting, F.struct(value.alias("v"))), ignorenulls=True).over(over)["v"]


def last_stated(value: Column, over: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(over)


def island(change: Column, over: WindowSpec) -> Column:
    """A number for each run of rows without change."""
    return F.sum(F.coalesce(change, F.lit(False)).cast("int")).over(over)


def request_clock(rows: DataFrame, key: Cols, order: Cols, request: Column, counts: Mapping[str, Column], state: Mapping[str, Column], keep: Cols) -> DataFrame:
    """One row per request: what happened since the previous one.

    counts: conditions counted between requests (reset at each); state: columns already computed per
    row and read at the request; keep: the request's own columns. One window and one grouping on
    the same key, so the rows are shuffled once.
    """
    segment = F.coalesce(F.sum(request.cast("int")).over(before(key, order)), F.lit(0)).cast("long")
    marked = rows.withColumns({"__request": request, "segment": segment, **{f"__{n}": c for n, c in state.items()}})
    at = lambda c: F.max(F.when(F.col("__request"), F.struct(F.col(c).alias("v"))))["v"]  # noqa: E731  one request a segment
    out = marked.groupBy(*key, "segment").agg(
        *(at(c).alias(c) for c in keep), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()), *(at(f"__{n}").alias(n) for n in state), F.max("__request").alias("__any")
    )
    return out.where("__any").drop("__any")


def running_max(value: Column, key: Cols, order: Cols) -> Column:
    return F.max(value).over(upto(key, order))


def changed(value: Column, key: Cols, order: Cols) -> Column:
    """1 if the value differs from the row before, 0 if equal or that one is unknown, null if this one is unknown."""
    was = F.lag(value).over(timeline(key, order))
    return F.when(value.isNotNull(), F.when(was.isNull() | (was == value), 0).otherwise(1))


def first_rows(df: DataFrame, key: Cols, order: Sequence) -> DataFrame:
    """The first row of each key by a full order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
