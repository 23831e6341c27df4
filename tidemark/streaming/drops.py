"""Drop accounting: what was shed or refused is counted by key and told once its key has been quiet for a while.

The counts and the timers are state of the query, so a restart neither loses nor repeats them. The session needs the RocksDB
state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.store import droppable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET_MS = 2000
MOST_KEPT = 10_000  # rows of a key in one batch, beyond which droppable ones are shed


class _Counter(StatefulProcessor):
    def __init__(self, key: str, quiet_ms: int) -> None:
        self.key, self.quiet = key, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "dropped long, batches long")

    def _alarm(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = sum(int(r["dropped"].sum()) for r in rows)
        was = self.held.get() if self.held.exists() else (0, 0)
        self.held.update((was[0] + came, was[1] + 1))
        self._alarm(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        dropped, batches = self.held.get()
        self.held.clear()
        yield pd.DataFrame({self.key: [key[0]], "dropped": [dropped], "batches": [batches]})

    def close(self) -> None:
        pass


def drop_counts(drops: DataFrame, key: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, dropped, batches) of drops(key, dropped: long), a stream, when no drop of a key has come for ``quiet_ms``; each drop is told once.

    batches says over how many micro-batches they came. Rows of a key are added up before they reach its state. Of a batch table all is told at once.
    """
    rows = drops.select(F.col(key).cast("string").alias(key), F.col("dropped").cast("long").alias("dropped"))
    if not drops.isStreaming:
        return rows.groupBy(key).agg(F.sum("dropped").alias("dropped"), F.lit(1).cast("long").alias("batches"))
    counter = _Counter(key, quiet_ms)
    return rows.groupBy(key).transformWithStateInPandas(counter, f"`{key}` string, dropped long, batches long", "Append", "ProcessingTime")


def shed(rows: DataFrame, key: str, kind: str, most: int = MOST_KEPT) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, drops by key) of one batch: keys with more than ``most`` rows lose those of droppable kinds, no others."""
    crowd = rows.groupBy(key).agg(F.count("*").alias("__n"), F.count_if(droppable(kind)).alias("dropped")).where(F.col("__n") > most)
    lost = crowd.where("dropped > 0").select(key, "dropped")
    kept = rows.join(lost.select(F.col(key).alias("__k")), rows[key].eqNullSafe(F.col("__k")) & F.coalesce(droppable(kind), F.lit(False)), "left_anti")
    return kept, lost
