"""The change row: what a commit changed, what the sessions behind it did, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_test_path
from .joins import band_join
from .lineage import merge_verification
from .metrics import KEY, is_edit, is_request, is_run, is_snapshot, kind, stable_intervals
from .nulls import among, count_of
from .ordered import timeline

# fixed values: names of files that declare dependencies
MANIFESTS = (
    "package.json", "package-lock.json", "pyproject.toml", "requirements.txt", "uv.lock", "poetry.lock", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum",
)
CELLS = (
    "files_changed", "lines_added", "lines_removed", "subsystems_touched", "test_files_changed", "dependency_delta", "attempts_to_land", "fresh_input_tokens_total", "cache_read_tokens_total",
    "compactions", "verification_cycles", "edit_turnover_ratio", "stable_state_intervals", "unique_files_read", "merge_verification_ms", "merge_verification_failed", "rework_within_3",
)


def is_manifest(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*MANIFESTS)


def _sessions(acts: DataFrame) -> DataFrame:
    """One row a session: sums, how many rows state them, and the distinct files that it read and edited."""
    paths = lambda where: F.collect_set(among(where, "path"))
    own = acts.groupBy(*KEY).agg(
        count_of(is_request()).alias("requests"), *(f(among(is_request(), c)).alias(f"{c}_{n}") for c in ("fresh", "cache_read") for n, f in (("sum", F.sum), ("stated", F.count))),
        count_of(kind("compaction")).alias("compactions"), count_of(is_run()).alias("runs"), count_of(is_edit()).alias("edits"), count_of(is_snapshot()).alias("snapshots"), count_of(kind("file_read")).alias("reads"),
        paths(is_edit()).alias("edited"), paths(kind("file_read")).alias("read"),
    )
    return own.join(stable_intervals(acts).select(*KEY, "intervals"), list(KEY), "left")


def change_rows(changes: DataFrame, files: DataFrame, links: DataFrame, acts: DataFrame, outcomes: DataFrame, ahead: int = 3) -> DataFrame:
    """repo, sha, position, the seventeen CELLS and rework_within_3_lag3 of every change.

    changes(repo, sha, position, files_changed, lines_added, lines_removed); files(sha, path); links(sha, capture_id, attempt), attempt null for a session
    that only recorded the commit; acts: activities; outcomes(sha, outcome_id, verifies, duration_ms, status).

    Cells of paths are null without files, those of sessions without a linked session, a sum if a request doesn't state its part, a ratio
    without edits of named files, intervals without a snapshot. Rework (a later change of one of the same files) is decided once ``ahead``
    more changes of the repository are there; its lag is what was known then. Sessions are added up before they meet the changes.
    """
    named = files.where("path is not null").select("sha", "path").distinct()
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    paths = named.groupBy("sha").agg(
        F.count_distinct(top).alias("subsystems_touched"), F.count_if(is_test_path(F.col("path"))).alias("test_files_changed"), F.max(is_manifest(F.col("path")).cast("int")).alias("dependency_delta")
    )
    landed = links.groupBy("sha").agg(F.max("attempt").alias("attempts_to_land"))
    folded = links.select("sha", *KEY).distinct().join(_sessions(acts), list(KEY))
    total = lambda c: F.when(F.sum(f"{c}_stated") == F.sum("requests"), F.sum(f"{c}_sum"))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    process = folded.groupBy("sha").agg(
        total("fresh").alias("fresh_input_tokens_total"), total("cache_read").alias("cache_read_tokens_total"), F.sum("compactions").alias("compactions"), F.sum("runs").alias("verification_cycles"),
        F.try_divide(F.sum("edits"), F.nullif(distinct("edited"), F.lit(0))).alias("edit_turnover_ratio"), F.when(F.sum("snapshots") > 0, F.coalesce(F.sum("intervals"), F.lit(0))).alias("stable_state_intervals"),
        F.when(F.sum("reads") == 0, F.lit(0)).otherwise(F.nullif(distinct("read"), F.lit(0))).alias("unique_files_read"),
    )
    post = merge_verification(outcomes, "sha", F.col("verifies"), ["outcome_id"]).select("sha", F.col("duration_ms").alias("merge_verification_ms"), F.col("failed").alias("merge_verification_failed"))
    placed = changes.select("repo", "sha", "position").join(named, "sha")
    again = band_join(placed, placed.select("repo", "path", F.col("position").alias("later")), ["repo", "path"], "position", "later", 1, ahead).select("sha").distinct().withColumn("again", F.lit(1))
    rows = changes
    for side in (paths, landed, process, post, again):
        rows = rows.join(side, "sha", "left")
    w = timeline(["repo"], ["position"])
    rows = rows.withColumn("rework_within_3", F.when(F.lead("sha", ahead).over(w).isNotNull(), F.coalesce("again", F.lit(0))))
    return rows.withColumn("rework_within_3_lag3", F.lag("rework_within_3", ahead).over(w)).select("repo", "sha", "position", *CELLS, "rework_within_3_lag3")
