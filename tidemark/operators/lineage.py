"""Commits, the activities that reach them, and the outcomes that are about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import any_key_match

# fixed values: how sure a link is, best first, and the word for none
LADDER = ("explicit", "provider_reported", "tree_match_during", "tree_match_after", "heuristic")
UNLINKED = "unlinked"
# fixed values: status words of an outcome
PASSED, FAILED = ("pass", "passed", "ok", "success"), ("fail", "failed", "error")


def rung_rank(word: Column) -> Column:
    """0 for the best word of the ladder, after it UNLINKED, null for others."""
    return F.when(word.isin(*LADDER, UNLINKED), F.array_position(F.lit([*LADDER, UNLINKED]), word) - 1)


def best_rung(links: DataFrame, sha: str, word: str, order: list[str], activity: str) -> DataFrame:
    """sha, rung, first_activity: the best word that anyone recorded for it, and the first activity at that rung.

    Commits for which nobody recorded a known word are left out. One grouped pass.
    """
    rank = rung_rank(F.col(word))
    return links.where(rank.isNotNull()).groupBy(sha).agg(
        F.min_by(word, rank).alias("rung"), F.min_by(activity, F.struct(rank, *order)).alias("first_activity")
    )


def commit_links(links: DataFrame, base: DataFrame, sha: str, tree: str, activity: str) -> tuple[DataFrame, DataFrame]:
    """(row_sha, twin, n_links, activities) of the base's commits that links reach, and the refused links' (sha, reason).

    A link joins the base commit of its own sha, else the only one with the same tree (then its sha is the twin).
    Trees of several base commits are ambiguous; other links are off the base.
    """
    trees = base.groupBy(tree).agg(F.min(sha).alias("by_tree"), F.count("*").alias("owners"))
    own = base.select(F.col(sha).alias("own")).distinct()
    met = links.join(own, links[sha] == F.col("own"), "left").join(trees, tree, "left")
    target = F.coalesce("own", F.when(F.col("owners") == 1, F.col("by_tree")))
    met = met.withColumn("row_sha", target)
    twin = F.when(F.col(sha) != F.col("row_sha"), F.col(sha))
    rows = met.where("row_sha is not null").groupBy("row_sha").agg(
        F.max(twin).alias("twin"), F.count("*").alias("n_links"), F.array_sort(F.collect_set(activity)).alias("activities")
    )
    refused = met.where("row_sha is null").select(sha, F.when(F.col("owners") > 1, "ambiguous_tree").otherwise("off_base").alias("reason")).distinct()
    return rows, refused


def outcomes_about(outcomes: DataFrame, changes: DataFrame) -> DataFrame:
    """(sha, outcome_id) where an outcome names the sha, or the task and attempt that landed the change; each pair once.

    outcomes: outcome_id, sha, task, attempt; changes: sha, task, attempt. An OR-condition as a union of equi-joins, whose pairs aren't shuffled.
    """
    landed = F.when(F.col("task").isNotNull() & F.col("attempt").isNotNull(), F.struct("task", "attempt"))
    found = any_key_match(outcomes.withColumn("__landed", landed), changes.withColumn("__landed", landed), [("sha", "sha"), ("__landed", "__landed")], ["outcome_id"], ["sha"])
    return found.select("sha", "outcome_id")


def known_pass(status: Column) -> Column:
    return F.when(F.lower(status).isin(*PASSED), True).when(F.lower(status).isin(*FAILED), False)


def merge_verification(outcomes: DataFrame, key: str, kind: Column, order: list[str]) -> DataFrame:
    """key, duration_ms, failed and why either is unknown, from the last verification outcome of each change."""
    last = outcomes.groupBy(key).agg(F.max_by(F.struct("duration_ms", "status"), F.when(kind, F.struct(*order))).alias("o"), F.bool_or(kind).alias("any"))
    state = known_pass(F.col("o.status"))
    none = F.when(~F.col("any"), "no_verification")
    return last.select(
        key, F.col("o.duration_ms").alias("duration_ms"), (~state).cast("int").alias("failed"),
        F.coalesce(none, F.when(F.col("o.duration_ms").isNull(), "no_duration")).alias("why_no_duration"),
        F.coalesce(none, F.when(state.isNull(), "unreadable_status")).alias("why_no_flag"),
    )


def cohort_record(rows: DataFrame, key: str) -> DataFrame:
    """key with the numbers of captures, attempts and dropped rows, and the providers, of a lineage's rows."""
    kept = F.col("dropped").isNull()
    return rows.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("provider")))), ",").alias("providers"), F.count_distinct(F.when(kept, F.col("capture_id"))).alias("captures"),
        F.count_if(kept).alias("attempts"), F.count_if(~kept).alias("drops"),
    )
