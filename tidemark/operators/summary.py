"""Session summaries, coverage by capability, observations from logs, and what triggers a snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calls import EDIT_TOOLS

# fixed values: coverage words, best first; the normal form of a command that commits
WORDS = ("observed", "derived", "partial", "unavailable")
COMMITS = r"(^|&& |\|\| |; |\| )git( -\S+( (?!commit)[^-\s]\S*)?)* commit( |$)"


def summary_rows(wide: DataFrame, key: str, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, position, block, metric, value) of a session's metrics in the fixed order of the blocks; unknown values stay rows."""
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(block).alias("block"), F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        for i, (block, name) in enumerate((b, n) for b, names in blocks.items() for n in names)
    ]
    return wide.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def summary_json(wide: DataFrame, key: str, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, summary): the blocks as nested JSON, null where a metric is unknown."""
    nested = F.struct(*[F.struct(*names).alias(block) for block, names in blocks.items()])
    return wide.select(key, F.to_json(nested, {"ignoreNullFields": "false"}).alias("summary"))


def capability_coverage(delivered: DataFrame, key: str, surface: str, capabilities: DataFrame) -> DataFrame:
    """(key, capability, coverage): the best word of the surfaces that a capture delivered, unavailable if none has the capability.

    capabilities: surface, capability, word: a fixed, small table.
    """
    rank = F.array_position(F.lit(list(WORDS)), F.col("word"))
    table = F.broadcast(capabilities.withColumnRenamed("surface", surface))
    best = delivered.select(key, surface).distinct().join(table, surface).groupBy(key, "capability").agg(F.min(rank).alias("r"))
    every = delivered.select(key).distinct().join(F.broadcast(capabilities.select("capability").distinct()))
    word = F.element_at(F.lit(list(WORDS)), F.coalesce("r", F.lit(len(WORDS))).cast("int"))
    return every.join(best, [key, "capability"], "left").select(key, "capability", word.alias("coverage"))


def log_observations(records: DataFrame, provider: str, event: str, session: str, consumed: Sequence[str]) -> DataFrame:
    """(type, session, payload) of log or metric rows with an attribute map: what is consumed leaves the payload.

    event, session: names of the attributes that hold them. Rows without an event are of type ``.unknown``.
    """
    a = F.col("attributes")
    kind = F.concat(F.lit(f"{provider}.otel."), F.coalesce(F.when(a[event] != "", a[event]), F.lit("unknown")))
    gone = [event, session, *consumed]
    return records.select(*[c for c in records.columns if c != "attributes"], kind.alias("type"), a[session].alias("session"), F.map_filter(a, lambda k, v: ~k.isin(*gone)).alias("payload"))


def snapshot_trigger(provider: Column, tool: Column, kind: Column, command: Column, item: Column, phase: Column) -> Column:
    """Why a record means that the repository should be looked at now, or null.

    A tool that writes a file; a message that says so; a command that has run and commits. Of the other provider's items,
    a change of a file that has ended.
    """
    ran = kind.endswith("tool_result")
    first = F.when(tool.isin(*EDIT_TOOLS), "file_mutation").when(kind.endswith("vcs_state_changed"), "vcs_state_changed").when(ran & command.rlike(COMMITS), "commit_command")
    second = F.when((item == "file_change") & F.coalesce(phase, F.lit("completed")).isin("completed", "failed"), "file_mutation")
    return F.when(provider == "claude", first).when(provider == "codex", second)


def placebo_and_baseline_checks(scores: DataFrame, key: list[str], margin: float = 0.0) -> DataFrame:
    """(key, check, passes) of the checks that need scores: baselines (any has one), placebo (the true order beats its median placebo).

    scores: key, ordering ('true' or a placebo's name), mae.
    """
    placebo = F.when(F.col("ordering") != "true", F.col("mae"))
    g = scores.groupBy(*key).agg(F.min(F.when(F.col("ordering") == "true", F.col("mae"))).alias("own"), F.percentile(placebo, F.lit(0.5)).alias("twin"))
    checks = {"baselines": F.col("own").isNotNull(), "placebo": F.coalesce(F.col("own") < F.col("twin") * (1 - margin), F.lit(False))}
    return g.select(*key, F.explode(F.map_from_arrays(F.lit(list(checks)), F.array(*checks.values()))).alias("check", "passes"))


def target_registry(evidence: DataFrame, targets: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """(target, unit, declarable, sessions, unknown) of the metrics in evidence(metric, value) that can be forecast.

    targets: each one's unit and whether a scenario may declare it. sessions counts rows with a known value, unknown those without.
    """
    table = evidence.sparkSession.createDataFrame([(k, unit, may) for k, (unit, may) in sorted(targets.items())], "target string, unit string, declarable boolean")
    held = evidence.groupBy(F.col("metric").alias("target")).agg(F.count("value").alias("sessions"), F.count_if(F.col("value").isNull()).alias("unknown"))
    return held.join(F.broadcast(table), "target").select("target", "unit", "declarable", "sessions", "unknown")
