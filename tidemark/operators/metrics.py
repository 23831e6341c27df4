"""Per-session metrics over activities, with coverage, in three-valued logic.

``base`` metrics need no order; the others compute window columns first. All use one partitioning by
session. Activities need: capture_id, activity_id, ts, kind and the fields named in the metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .nulls import all_known, among, count_of, coverage, distinct_three, ratio, sum_known
from .ordered import carried, island, timeline, upto

KEY, ORDER = ["capture_id"], ["ts", "activity_id"]
FAILURE_BUDGET = 3  # edits counted after each failed run


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def is_edit() -> Column:
    return kind("file_edit")


def is_read() -> Column:
    return kind("file_read")


def is_run() -> Column:
    return kind("verification_run")


def is_request() -> Column:
    return kind("model_request")


def is_snapshot() -> Column:
    return kind("repo_snapshot")


def is_compaction() -> Column:
    return kind("compaction")


def is_tool() -> Column:
    return kind("tool_call")


def is_test() -> Column:
    return is_run() & (F.col("category") == "test")


def base_metrics(acts: DataFrame) -> DataFrame:
    """Counts, token sums with coverage, and run outcomes of each session."""
    failed = ~F.col("success")
    return acts.groupBy(*KEY).agg(
        count_of(is_request()).alias("model_requests"),
        *(sum_known(is_request(), c).alias(f"{c}_tokens") for c in ("fresh", "cache_read", "cache_creation", "output")),
        coverage(is_request(), "output").alias("output_coverage"),
        coverage(is_request(), "cache_read").alias("cache_read_coverage"),
        distinct_three(is_edit(), "path").alias("unique_files_changed"),
        F.when(count_of(is_edit()) == 0, F.lit(0)).otherwise(F.when(F.count(among(is_edit(), "path")) > 0, F.count(among(is_edit(), "path")) - F.countDistinct(among(is_edit(), "path")))).cast("long").alias("file_revisits"),
        F.max(among(is_snapshot(), F.coalesce(F.col("additions") + F.col("deletions"), F.col("additions"), F.col("deletions")))).alias("max_diff_lines"),
        F.max_by(among(is_snapshot(), F.coalesce(F.col("additions") + F.col("deletions"), F.col("additions"), F.col("deletions"))), F.when(is_snapshot() & F.coalesce("additions", "deletions").isNotNull(), F.struct(*ORDER))).alias("final_diff_lines"),
        count_of(is_tool() & ~F.col("executed")).alias("refused_tool_calls"),
        count_of(is_test()).alias("agent_test_runs"),
        all_known(is_test(), "success", count_of(is_test() & failed)).alias("failed_test_runs"),
        count_of(is_test() & (F.col("scope") == "targeted")).alias("targeted_test_runs"),
        count_of(is_test() & (F.col("scope") == "full")).alias("full_test_runs"),
        distinct_three(is_read(), "path").alias("unique_files_read"),
        count_of(is_compaction()).alias("compactions"),
        sum_known(is_compaction(), "pre_tokens").alias("pre_compaction_tokens"),
        sum_known(is_compaction(), "post_tokens").alias("post_compaction_tokens"),
        F.when(count_of(is_read()) == 0, F.lit(0)).otherwise(F.nullif(F.countDistinct(among(is_read(), directory(F.col("path")))), F.lit(0))).cast("long").alias("directories_traversed"),
    )


def directory(path: Column) -> Column:
    """The parent folder; '.' for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit("."))


def ratios(acts: DataFrame) -> DataFrame:
    m = base_metrics(acts)
    dirs = acts.where(is_edit()).groupBy(*KEY).agg(F.nullif(F.countDistinct(directory(F.col("path"))), F.lit(0)).alias("edited_dirs"))
    return m.join(dirs, KEY, "left").select(
        *KEY, ratio(F.col("unique_files_read"), F.nullif(F.col("unique_files_changed"), F.lit(0))).alias("read_to_edit_ratio"), ratio(F.col("directories_traversed"), F.col("edited_dirs")).alias("explored_to_final_ratio")
    )


def reversions(acts: DataFrame) -> DataFrame:
    """Snapshots whose diff was seen before and isn't the previous one's."""
    snaps = acts.where(is_snapshot() & F.col("diff_hash").isNotNull())
    again = F.row_number().over(Window.partitionBy(*KEY, "diff_hash").orderBy(*ORDER)) > 1
    rows = snaps.select(*KEY, ((F.col("diff_hash") != F.lag("diff_hash").over(timeline(KEY, ORDER))) & again).alias("back"))
    return rows.groupBy(*KEY).agg(F.count_if(F.coalesce("back", F.lit(False))).alias("reversions"))


def post_failure_revisits(acts: DataFrame, budget: int = FAILURE_BUDGET) -> DataFrame:
    """Edits to known files within a budget of edits that each failed run opens anew; null if a run's outcome is unknown."""
    rows = acts.where(is_edit() | is_run()).withColumn("failures", F.count(among(is_run() & ~F.col("success"), F.lit(1))).over(upto(KEY, ORDER)))
    rows = rows.withColumn("nth", F.sum(is_edit().cast("int")).over(timeline([*KEY, "failures"], ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy(*KEY, "kind", "path").orderBy(*ORDER)) > 1)
    inside = is_edit() & (F.col("failures") > 0) & (F.col("nth") <= budget) & F.col("path").isNotNull() & F.col("again")
    return rows.groupBy(*KEY).agg(all_known(is_run(), "success", count_of(inside)).alias("post_failure_revisits"))


def fail_to_pass(acts: DataFrame) -> DataFrame:
    """Passes right behind a failure of the same category; null if any outcome is unknown."""
    runs = acts.where(is_run()).withColumn("was", F.lag("success").over(timeline([*KEY, "category"], ORDER)))
    return runs.groupBy(*KEY).agg(all_known(is_run(), "success", count_of(F.col("success") & ~F.col("was"))).alias("fail_to_pass_cycles"))


def edits_after_success(acts: DataFrame) -> DataFrame:
    """Edits after the last known passed run; null if a later run (or, without a pass, any run) has an unknown outcome."""
    rows = acts.where(is_edit() | is_run())
    rows = rows.withColumn("passes", F.count(among(is_run() & F.col("success"), F.lit(1))).over(upto(KEY, ORDER)))
    rows = rows.withColumn("all_passes", F.max("passes").over(Window.partitionBy(*KEY)))
    after = F.col("passes") == F.col("all_passes")
    return rows.groupBy(*KEY).agg(
        F.when(count_of(is_run() & after & F.col("success").isNull()) == 0, F.when(F.max("all_passes") > 0, count_of(is_edit() & after)).otherwise(F.lit(0))).cast("long").alias("edits_after_last_success")
    )


def edit_epochs(acts: DataFrame) -> DataFrame:
    """Runs of edits that a verification run closed, and whether the session ends in an open one."""
    rows = acts.where(is_edit() | is_run()).withColumn("was", F.lag("kind").over(timeline(KEY, ORDER)))
    return rows.groupBy(*KEY).agg(
        count_of(is_run() & (F.col("was") == "file_edit")).alias("epochs_with_verification"),
        (F.max_by("kind", F.struct(*ORDER)) == "file_edit").cast("long").alias("epochs_without_verification"),
    )


def read_before_first_edit(acts: DataFrame) -> DataFrame:
    """Distinct files read before the first edit; null without edits, or if reads there never state a path."""
    rows = acts.withColumn("first", F.min(among(is_edit(), F.struct(*ORDER))).over(Window.partitionBy(*KEY)))
    early = is_read() & (F.struct(*ORDER) < F.col("first"))
    return rows.where("first is not null").groupBy(*KEY).agg(distinct_three(early, "path").alias("read_before_first_edit"))


def occupancy(acts: DataFrame, window: int) -> DataFrame:
    """The largest share of the window that a request's known input fills, and the request (the first of equals)."""
    known = F.coalesce("fresh", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_creation", F.lit(0))
    rows = acts.where(is_request()).withColumn("used", known)
    best = F.max_by("activity_id", F.struct("used", (-F.col("activity_id")).alias("i")))
    return rows.groupBy(*KEY).agg((F.max("used") / F.lit(window)).alias("occupancy_ratio"), best.alias("source_activity"))


def stable_intervals(acts: DataFrame) -> DataFrame:
    """Maximal runs of work under one state of diff and last verification: how many, how they end, and their tokens.

    A snapshot sets the diff though it be unknown. The verification half holds the category, the outcome and
    the diff in force at that run. An interval ends by an edit if the diff moved, else by
    a verification; the last one ends with the capture.
    """
    over = upto(KEY, ORDER)
    rows = acts.withColumn("diff", carried(is_snapshot(), F.col("diff_hash"), over))
    rows = rows.withColumn("check", carried(is_run(), F.struct("category", "success", "diff"), over))
    work = rows.where(kind("model_request", "tool_call", "file_read", "file_edit"))
    state, was = F.struct("diff", "check"), F.lag(F.struct("diff", "check")).over(timeline(KEY, ORDER))
    start = F.row_number().over(timeline(KEY, ORDER)) == 1
    work = work.withColumn("change", ~start & ~state.eqNullSafe(was))
    work = work.withColumn("interval", island(F.col("change"), over))
    total = F.col("fresh") + F.col("cache_read") + F.col("cache_creation") + F.col("output")
    each = work.groupBy(*KEY, "interval").agg(
        F.first(F.struct("diff")).alias("diff"), F.when(count_of(is_request()) > 0, F.when(count_of(is_request() & total.isNull()) == 0, F.sum(among(is_request(), total)))).alias("tokens"),
        F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("span"), F.count("*").alias("n"),
    )
    after = F.lead("diff").over(timeline(KEY, ["interval"]))
    each = each.withColumn("ended", F.when(after.isNull(), "end").when(~after.eqNullSafe(F.col("diff")), "edit").otherwise("verification"))
    spans = among(F.col("n") > 1, F.col("span") / 1000.0)
    return each.groupBy(*KEY).agg(
        F.count("*").alias("intervals"), F.sum(spans).alias("total_ms"), F.max(spans).alias("max_ms"), F.sum("tokens").alias("tokens"),
        *(F.count_if(F.col("ended") == e).alias(f"ended_by_{e}") for e in ("edit", "verification", "end")),
    )


def delegated_calls(acts: DataFrame, agents: DataFrame) -> DataFrame:
    """Sub-sessions, tool calls delegated to one (by agent or parent, each counted once) and direct calls."""
    calls = acts.where(is_tool())
    by_agent = calls.join(agents.select(*KEY, "agent"), [*KEY, "agent"], "left_semi").select(*KEY, "activity_id")
    by_parent = calls.join(agents.select(*KEY, F.col("parent").alias("activity_id")), [*KEY, "activity_id"], "left_semi").select(*KEY, "activity_id")
    named = by_agent.unionByName(by_parent).distinct().groupBy(*KEY).agg(F.count("*").alias("delegated"))
    subs = agents.groupBy(*KEY).agg(F.count("*").alias("subagent_count"))
    out = calls.groupBy(*KEY).agg(F.count("*").alias("n")).join(named, KEY, "left").join(subs, KEY, "left")
    return out.select(*KEY, F.coalesce("subagent_count", F.lit(0)).alias("subagent_count"), F.coalesce("delegated", F.lit(0)).alias("delegated_tool_calls"), (F.col("n") - F.coalesce("delegated", F.lit(0))).alias("direct_tool_calls"))


def compaction_episodes(rows: DataFrame, role: str) -> DataFrame:
    """rows with an episode number: a new one opens where the role is already in the open one.

    The choice depends on all earlier ones of the session, so the roles of each session are folded in order.
    """
    item = F.struct(*ORDER, F.col(role).alias("role"))
    folded = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        *KEY,
        F.expr("""explode(aggregate(items, named_struct('out', cast(array() as array<struct<activity_id:bigint,episode:int>>), 'open', cast(array() as array<string>), 'n', 1),
          (s, x) -> if(array_contains(s.open, x.role),
            named_struct('out', array_append(s.out, named_struct('activity_id', x.activity_id, 'episode', s.n + 1)), 'open', array(x.role), 'n', s.n + 1),
            named_struct('out', array_append(s.out, named_struct('activity_id', x.activity_id, 'episode', s.n)), 'open', array_append(s.open, x.role), 'n', s.n)), s -> s.out))""").alias("e"),
    )
    return folded.select(*KEY, "e.activity_id", "e.episode")


def evidence(wide: DataFrame) -> DataFrame:
    """One row per session and metric, with a deterministic id; null values stay rows."""
    names = [c for c, t in wide.dtypes if c not in KEY and t in ("bigint", "int", "double", "long")]
    long = wide.unpivot(KEY, [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    return long.withColumn("evidence_id", F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", F.col("capture_id").cast("string"), "metric"), 256), 1, 24)))


