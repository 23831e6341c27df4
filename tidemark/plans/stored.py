"""Queries over a versioned store that is filled from the tables: replacement, rebuilds of what has changed, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import exports as X
from ..sources.files import shared_folder
from ..sources.store import Store
from .staging import ACTIVITIES_SQL, activities


def _store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _observations(spark, d):
    return activities(spark, d).select("capture_id", "activity_id", "ts", "kind", "fresh", "output")


def _tokens(rows):
    """Activities of a session: requests with all that they used."""
    return rows.withColumn("tokens", F.col("fresh") + F.col("output"))


def _evidence(rows):
    return rows.groupBy("capture_id").agg(
        F.count("*").alias("activities"), F.count_if(F.col("kind") == "model_request").alias("requests"), F.sum("tokens").alias("tokens"), F.max("activity_id").alias("last_id")
    )


DERIVED = [("activities", _tokens), ("evidence", _evidence)]


def q_store_replaced(spark, d):
    """All rows of the sessions with an even id are replaced by their requests, the others stay."""
    s, rows = _store(spark), _observations(spark, d)
    s.append("activities", rows)
    even = rows.where("capture_id % 2 = 0")
    s.replace("activities", even.where("kind = 'model_request'").withColumn("output", F.lit(-1).cast("long")), even)
    return s.table("activities").select("capture_id", "activity_id", "kind", "fresh", "output")


def q_store_rebuilt(spark, d):
    """Rows come in two loads, the second late ones of some sessions; evidence is rebuilt after each, the second time of those sessions only."""
    s, rows = _store(spark), _observations(spark, d)
    late = (F.col("capture_id") % 5 == 0) & (F.col("activity_id") % 3 == 0)
    s.append("observations", rows.where(~late))
    s.rebuild(DERIVED)
    s.append("observations", rows.where(late))
    s.rebuild(DERIVED)
    return s.table("evidence")


def q_store_purged(spark, d):
    """Sessions with an id that 7 divides are purged from the source and from what is derived of it."""
    s, rows = _store(spark), _observations(spark, d)
    s.append("observations", rows)
    s.rebuild(DERIVED)
    s.purge(rows.where("capture_id % 7 = 0"), ["observations"])
    s.rebuild(DERIVED)
    return s.table("activities").groupBy("kind").agg(F.countDistinct("capture_id").alias("sessions"), F.count("*").alias("rows"))


def q_store_exported(spark, d):
    """A pinned version's tables as canonical JSON lines, read back: rows that came during the export aren't in it."""
    s, rows = _store(spark), _observations(spark, d).drop("ts")
    s.append("observations", rows)
    s.rebuild(DERIVED)
    pinned = s.pin()
    s.append("observations", rows.withColumn("kind", F.lit("came later")))
    s.rebuild(DERIVED)
    out = f"{s.root}-export"
    X.export(pinned, out, "jsonl", order={"observations": ["capture_id", "activity_id"]})
    back = X.read_export(spark, out)
    counts = back["observations"].groupBy("capture_id", "kind").agg(F.count("*").alias("observed"))
    return counts.join(back["evidence"].select("capture_id", "activities", "tokens"), "capture_id")


ROWS = f"WITH {ACTIVITIES_SQL}"
SQL = {
    "store_replaced": f"""{ROWS} SELECT capture_id, activity_id, kind, fresh, CASE WHEN capture_id % 2 = 0 THEN -1 ELSE output END AS output FROM act
  WHERE capture_id % 2 <> 0 OR kind = 'model_request'""",
    "store_rebuilt": f"""{ROWS} SELECT capture_id, count(*) AS activities, count(*) FILTER (kind = 'model_request') AS requests,
  sum(fresh + output)::BIGINT AS tokens, max(activity_id) AS last_id FROM act GROUP BY capture_id""",
    "store_purged": f"""{ROWS} SELECT kind, count(DISTINCT capture_id) AS sessions, count(*) AS rows FROM act WHERE capture_id % 7 <> 0 GROUP BY kind""",
    "store_exported": f"""{ROWS}, e AS (SELECT capture_id, count(*) AS activities, sum(fresh + output)::BIGINT AS tokens FROM act GROUP BY capture_id)
  SELECT capture_id, kind, observed, activities, tokens FROM (SELECT capture_id, kind, count(*) AS observed FROM act GROUP BY ALL) JOIN e USING (capture_id)""",
}
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
