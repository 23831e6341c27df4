"""How sure a commit is of a capture: a ladder from what is stated over what trees show to what the clock allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import LADDER, UNLINKED, rung_rank

# fixed values: how long behind a capture's end a commit may come, the snapshot at the end, and the hash of an empty diff
AFTER_SECONDS = 600
AT_END = "capture_end"
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def confidence(commits: DataFrame, captures: DataFrame, snapshots: DataFrame, stated: DataFrame, heuristic: bool = False, after: int = AFTER_SECONDS, empty: str = EMPTY, width: int = 3600) -> DataFrame:
    """(capture, sha, rung, known): the best rung of each commit that a capture reaches; known is false for stated shas that no commit has.

    commits(repo, sha, parent, patch, at), parent null unless there is just one; captures(capture, repo, start, end);
    snapshots(capture, head, diff, trigger); stated(capture, sha, rung), explicit or provider_reported, which hold at any time.

    A snapshot shows a commit's tree if its head is the commit and its diff is empty, or if its head is the parent and its diff is the
    patch. Seen only at the capture's end, or made behind it, that is tree_match_after, else tree_match_during. A commit counts from the second
    in which the capture starts to ``after`` seconds behind its end. Time alone is a link (heuristic) only if that is asked for.

    Trees and statements meet by equi-joins; times by buckets of ``width`` seconds, doubled until a capture covers three at most. Nothing that
    grows with the captures is broadcast: what the planner takes for small is many times larger behind an explode.
    """
    made = commits.select("repo", "sha", "parent", "patch", "at")
    seen = snapshots.where("head is not null and diff is not null").select("capture", "head", "diff", (F.coalesce("trigger", F.lit(AT_END)) != AT_END).alias("during"))
    # both shapes are one equi-join: a commit is looked for under either of its states
    states = F.explode(F.array(F.struct(F.col("sha").alias("head"), F.lit(empty).alias("diff")), F.struct(F.col("parent").alias("head"), F.col("patch").alias("diff")))).alias("state")
    shown = made.select("repo", "sha", "at", states).select("repo", "sha", "at", "state.*").where("head is not null and diff is not null")
    own = captures.select("capture", F.col("repo").alias("__repo"), F.expr("start - make_dt_interval(0, 0, 0, extract(SECOND FROM start) % 1)").alias("__start"), F.col("end").alias("__end"))
    late = F.col("__end") + F.make_dt_interval(secs=F.lit(after))
    pairs = shown.join(seen.hint("merge"), ["head", "diff"]).join(own.hint("merge"), "capture").where((F.col("repo") == F.col("__repo")) & F.col("at").between(F.col("__start"), late))
    trees = pairs.groupBy("capture", "sha").agg(F.bool_or("during").alias("during"), F.bool_or(F.col("at") > F.col("__end")).alias("behind"))
    found = trees.select("capture", "sha", F.when(F.col("during") & ~F.col("behind"), "tree_match_during").otherwise("tree_match_after").alias("rung"))
    found = found.unionByName(stated.select("capture", "sha", "rung"))
    if heuristic:
        seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
        bucket = lambda c: F.floor(seconds(c) / (F.pow(F.lit(2.0), F.col("__level")) * width))
        level = F.ceil(F.log2(F.greatest((seconds(late) - seconds(F.col("__start"))) / width, F.lit(1.0)))).cast("int")
        covered = own.withColumn("__level", level).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__start")), bucket(late))))
        # a commit looks only at the levels that captures of its repository have
        levels = covered.select("__repo", "__level").distinct()
        near = made.join(levels.hint("merge"), F.col("repo") == F.col("__repo")).select("repo", "sha", "at", "__level").withColumn("__bucket", bucket(F.col("at")))
        near = near.join(covered.withColumnRenamed("__repo", "repo").hint("merge"), ["repo", "__level", "__bucket"])
        found = found.unionByName(near.where(F.col("at").between(F.col("__start"), late)).select("capture", "sha", F.lit("heuristic").alias("rung")))
    best = found.groupBy("capture", "sha").agg(F.min(rung_rank(F.col("rung"))).alias("rank"))
    best = best.select("capture", "sha", F.get(F.lit([*LADDER, UNLINKED]), F.col("rank").cast("int")).alias("rung"))
    return best.join(made.select("sha").distinct().hint("merge").withColumn("known", F.lit(True)), "sha", "left").select("capture", "sha", "rung", F.coalesce("known", F.lit(False)).alias("known"))
