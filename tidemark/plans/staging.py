"""The relational test tables read as the engine's own entities.

``activities``: one row per event. Purchases are model requests, clicks file edits, errors and
sign-ups verification runs (failed, passed), views one of four other kinds by their ``k``.
Fields a kind doesn't state are null; some stated ones are null too, so that "unknown" is exercised.
``ACTIVITIES_SQL`` is the same staging for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt evenly by their key: a file of narrow rows has few row groups, and each is one task, however much work its rows are."""
    return rows.repartition(max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism), *key)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = (
        F.when(F.col("event_type") == "purchase", "model_request")
        .when(F.col("event_type") == "click", "file_edit")
        .when(F.col("event_type").isin("error", "signup"), "verification_run")
        .when(k % 4 == 0, "repo_snapshot").when(k % 4 == 1, "compaction").when(k % 4 == 2, "tool_call").otherwise("file_read")
    )

    def of(kinds: str | list[str], value):
        return F.when(F.col("kind").isin(*([kinds] if isinstance(kinds, str) else kinds)), value)

    path = F.when(k % 6 == 5, F.lit("README.md")).when(k % 13 != 0, F.concat(F.lit("src/d"), (k % 5).cast("string"), F.lit("/f"), (k % 11).cast("string"), F.lit(".py")))
    return events.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("activity_id"), "ts", "event_type", "value", "k", kind.alias("kind")).select(
        "*",
        of(["file_edit", "file_read"], path).alias("path"),
        of("verification_run", F.when(k % 9 != 0, F.col("event_type") == "signup")).alias("success"),
        of("verification_run", F.when(k % 4 == 3, "lint").otherwise("test")).alias("category"),
        of("verification_run", F.when(k % 2 == 0, "targeted").otherwise("full")).alias("scope"),
        of("model_request", F.floor("value").cast("long")).alias("fresh"),
        of("model_request", F.when(k % 5 != 0, k * 10)).cast("long").alias("cache_read"),
        of("model_request", F.when(k % 7 != 0, k)).cast("long").alias("cache_creation"),
        of("model_request", F.when(k % 11 != 0, k * 3)).cast("long").alias("output"),
        of("model_request", F.concat(F.lit("m"), (k % 3).cast("string"))).alias("model"),
        of("repo_snapshot", F.when(k % 8 != 0, F.concat(F.lit("h"), F.floor(k / 4).cast("int") % 3))).alias("diff_hash"),
        of("repo_snapshot", k).cast("long").alias("additions"),
        of("repo_snapshot", F.when(k % 12 != 0, k % 7)).cast("long").alias("deletions"),
        of("compaction", F.when(k % 5 != 1, k * 100)).cast("long").alias("pre_tokens"),
        of("compaction", F.when(k % 3 != 0, k * 10)).cast("long").alias("post_tokens"),
        of("tool_call", k % 16 != 2).alias("executed"),
        of("tool_call", F.concat(F.lit("a"), (k % 6).cast("string"))).alias("agent"),
    )


ACTIVITIES_SQL = """act AS (SELECT *,
  CASE WHEN kind IN ('file_edit','file_read') THEN CASE WHEN k % 6 = 5 THEN 'README.md' WHEN k % 13 <> 0 THEN 'src/d' || (k % 5) || '/f' || (k % 11) || '.py' END END AS path,
  CASE WHEN kind = 'verification_run' AND k % 9 <> 0 THEN event_type = 'signup' END AS success,
  CASE WHEN kind = 'verification_run' THEN CASE WHEN k % 4 = 3 THEN 'lint' ELSE 'test' END END AS category,
  CASE WHEN kind = 'verification_run' THEN CASE WHEN k % 2 = 0 THEN 'targeted' ELSE 'full' END END AS scope,
  CASE WHEN kind = 'model_request' THEN floor(value)::BIGINT END AS fresh,
  CASE WHEN kind = 'model_request' AND k % 5 <> 0 THEN (k * 10)::BIGINT END AS cache_read,
  CASE WHEN kind = 'model_request' AND k % 7 <> 0 THEN k::BIGINT END AS cache_creation,
  CASE WHEN kind = 'model_request' AND k % 11 <> 0 THEN (k * 3)::BIGINT END AS output,
  CASE WHEN kind = 'model_request' THEN 'm' || (k % 3) END AS model,
  CASE WHEN kind = 'repo_snapshot' AND k % 8 <> 0 THEN 'h' || (k // 4) % 3 END AS diff_hash,
  CASE WHEN kind = 'repo_snapshot' THEN k::BIGINT END AS additions,
  CASE WHEN kind = 'repo_snapshot' AND k % 12 <> 0 THEN (k % 7)::BIGINT END AS deletions,
  CASE WHEN kind = 'compaction' AND k % 5 <> 1 THEN (k * 100)::BIGINT END AS pre_tokens,
  CASE WHEN kind = 'compaction' AND k % 3 <> 0 THEN (k * 10)::BIGINT END AS post_tokens,
  CASE WHEN kind = 'tool_call' THEN k % 16 <> 2 END AS executed,
  CASE WHEN kind = 'tool_call' THEN 'a' || (k % 6) END AS agent
  FROM (SELECT user_id AS capture_id, event_id AS activity_id, ts, event_type, value, k,
    CASE event_type WHEN 'purchase' THEN 'model_request' WHEN 'click' THEN 'file_edit' WHEN 'error' THEN 'verification_run' WHEN 'signup' THEN 'verification_run'
      ELSE CASE k % 4 WHEN 0 THEN 'repo_snapshot' WHEN 1 THEN 'compaction' WHEN 2 THEN 'tool_call' ELSE 'file_read' END END AS kind
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"""
