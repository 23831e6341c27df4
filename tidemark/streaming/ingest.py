"""Structured Streaming: ingest with dead letters, first-seen announcements, debouncing and session maps.

Each function takes a batch or a streaming DataFrame alike, so a batch run says what the live one must give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEBOUNCE = "2 seconds"  # fixed value: the quiet time behind the last trigger


def debounce(triggers: DataFrame, key: str, at: str, reason: str, quiet: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """One row per burst of triggers: a burst ends by ``quiet`` time without one, and the last reason wins.

    There is no longest delay: triggers that keep coming keep a burst open. late: a watermark, for streams.
    """
    rows = triggers.withWatermark(at, late) if late else triggers
    burst = rows.groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.max_by(reason, F.struct(at, reason)).alias("reason"), F.count("*").alias("triggers"))
    return burst.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "reason", "triggers")


def first_seen(rows: DataFrame, key: str, at: str, late: str | None = None) -> DataFrame:
    """Streams: the first row that arrives of each key. Batches: the earliest one."""
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if late else rows.dropDuplicates([key])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(at, *[c for c in rows.columns if c != at])).alias("x")).select("x.*")


def session_map(rows: DataFrame, session: str, capture: str, at: str) -> DataFrame:
    """(session, capture, previous) for each time that a session's capture is learned or changes; a change is a conflict.

    Streams keep one capture a session in state; rows of a micro-batch are taken in time order.
    """
    if not rows.isStreaming:
        from pyspark.sql.window import Window

        was = F.lag(capture).over(Window.partitionBy(session).orderBy(at, capture))
        told = rows.where(F.col(capture).isNotNull()).withColumn("previous", was)
        return told.where(~F.col(capture).eqNullSafe(F.col("previous"))).select(session, capture, "previous")
    kinds = dict(rows.dtypes)

    def learn(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out = []
        for value in pd.concat(list(batches)).sort_values([at, capture])[capture].dropna():
            if value != held:
                out.append((key[0], value, held))
                held = value
        if held is not None:
            state.update((held,))
        yield pd.DataFrame(out, columns=[session, capture, "previous"])

    c = kinds[capture]
    return rows.groupBy(session).applyInPandasWithState(learn, f"`{session}` {kinds[session]}, `{capture}` {c}, previous {c}", f"held {c}", "append", "NoTimeout")


def ingest(lines: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good: str, bad: str, checkpoint: str):
    """A query that appends parsed lines and dead letters as Parquet, batch by batch.

    A batch that is run again replaces its own files, so a restart doubles nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows, letters = parse(batch)
        rows.write.mode("overwrite").parquet(f"{good}/batch={number}")
        letters.write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
