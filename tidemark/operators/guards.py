"""Guards and checks over series, reports, exports and experiments: each tells what is wrong as rows, or raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: words that a report may not use; coverage words of forecastable columns and of targets
FORBIDDEN = r"(?i)\b(caus(?:e|es|ed|ing)|impact(?:s|ed|ing)?|would)\b"
FORECASTABLE, TARGET_COVERAGE = ("observed", "derived"), ("observed", "derived", "partial")
MOST_COVARIATES = 15
LEVELS = tuple(k / 10 for k in range(1, 10))


def forbidden_words(text: Column) -> Column:
    """The distinct forbidden words of a text, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FORBIDDEN), F.lit(1)), F.lower)))


def refuse_words(reports: DataFrame, text: str) -> DataFrame:
    """reports, if none uses a forbidden word; else the first few words are named. To be called before anything is stored."""
    found = reports.select(F.explode(forbidden_words(F.col(text))).alias("word")).distinct().orderBy("word").limit(10).collect()
    if found:
        raise ValueError(f"a report may not use {', '.join(r.word for r in found)}")
    return reports


def emit(store, table: str, reports: DataFrame, text: str) -> None:
    """Append reports after the word check; nothing is written if one is refused."""
    store.change(lambda t: t.append(table, refuse_words(reports, text)))


def row_faults(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rows with faults: the names of the rules that don't hold; a rule that can't be decided doesn't hold."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("faults", F.array_compact(F.array(*broken)))


def blank_unobservable(rows: DataFrame, coverage: Mapping[str, str], key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns and their coverage words made to agree, both ways: (rows, (column, coverage)).

    An unavailable column becomes null in all rows; a column without any value is unavailable. A table without rows tells nothing.
    """
    seen = rows.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in coverage])
    words = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when((F.lit(w) != "unavailable") & (F.col("__n") > 0) & (F.col(c) == 0), "unavailable").otherwise(F.lit(w)).alias("coverage")) for c, w in coverage.items()
    ])
    gone = [c for c, w in coverage.items() if w == "unavailable"]
    blank = rows.withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in gone}) if gone else rows
    return blank, seen.select(F.explode(words).alias("x")).select("x.*")


def first_gaps(rows: DataFrame, order: str, observed: Sequence[str]) -> DataFrame:
    """(column, position) of the first hole of each observed column that has one; one grouped pass."""
    firsts = rows.agg(*[F.min(F.when(F.col(c).isNull(), F.col(order))).alias(c) for c in observed])
    return firsts.unpivot([], list(observed), "column", "position").where("position is not null")


def refuse_on_gaps(rows: DataFrame, order: str, observed: Sequence[str]) -> DataFrame:
    """rows, if no observed column has a hole; nothing is imputed."""
    gaps = first_gaps(rows, order, observed).orderBy("position", "column").first()
    if gaps is not None:
        raise ValueError(f"column {gaps.column} has coverage observed and no value in row {gaps.position}")
    return rows


def variant(coverage: DataFrame, target: str, named: Sequence[str] | None = None) -> DataFrame:
    """(column, coverage, chosen, why) of a series' columns as covariates of a target.

    Columns that can't be forecast from are kept out and say so; with named columns, the others are, too, and a named
    one that the series lacks is ``missing``.
    """
    rows = coverage.where(F.col("column") != target)
    fits = F.col("coverage").isin(*FORECASTABLE)
    if named is not None:
        wanted = coverage.sparkSession.createDataFrame([(n,) for n in named if n != target], "column string").withColumn("named", F.lit(True))
        rows = rows.join(F.broadcast(wanted), "column", "full")
        why = F.when(F.col("coverage").isNull(), "missing").when(F.col("named").isNull(), "not_named").when(~fits, "coverage")
    else:
        why = F.when(~fits, "coverage")
    return rows.select("column", "coverage", why.isNull().alias("chosen"), why.alias("why"))


def capped(chosen: DataFrame, most: int = MOST_COVARIATES) -> DataFrame:
    """chosen, if it has at most ``most`` covariates."""
    n = chosen.where("chosen").count()
    if n > most:
        raise ValueError(f"{n} covariates, at most {most}")
    return chosen


def scored(windows: DataFrame, steps: Sequence[int], arrays: Sequence[str]) -> DataFrame:
    """windows with their arrays cut to 1-based steps; a step outside of a window gives a null array."""
    size = F.size(arrays[0])
    inside = (F.lit(min(steps)) >= 1) & (F.lit(max(steps)) <= size)
    cut = lambda c: F.when(inside, F.array(*[F.try_element_at(F.col(c), F.lit(s)) for s in steps]))
    return windows.withColumns({c: cut(c) for c in arrays})


def silent_surfaces(configured: Column, delivered: Column) -> Column:
    """Configured surfaces that delivered nothing, sorted."""
    return F.array_sort(F.array_except(configured, F.coalesce(delivered, F.array().cast("array<string>"))))


def health(rows: DataFrame, surface: str, at: str, dropped: Column) -> DataFrame:
    """surface, received, drops and last_ingest: what came and what was shed."""
    return rows.groupBy(surface).agg(F.count_if(~dropped).alias("received"), F.count_if(dropped).alias("drops"), F.max(F.when(~dropped, F.col(at))).alias("last_ingest"))


def filled_union(vectors: DataFrame, key: str, name: str, value: str, zero_if_stream: Column) -> DataFrame:
    """Every key with every metric that any key has: its value, else 0 where the key's stream was seen, else null."""
    names = vectors.select(name).distinct()
    keys = vectors.groupBy(key).agg(F.bool_or(zero_if_stream).alias("seen"))
    grid = keys.join(F.broadcast(names))  # metrics are a fixed, small set
    return grid.join(vectors.select(key, name, value), [key, name], "left").select(key, name, F.coalesce(value, F.when(F.col("seen"), F.lit(0.0))).alias(value))


def mixed_conditions(rows: DataFrame, condition: str, fingerprint: str) -> DataFrame:
    """(condition, n) of conditions whose captures don't have exactly one known fingerprint."""
    n = F.count_distinct(fingerprint)
    return rows.groupBy(condition).agg(n.alias("n"), F.count_if(F.col(fingerprint).isNull()).alias("unknown")).where("n <> 1 or unknown > 0")


def claims(captures: DataFrame, task: str, attempt: str, ident: str) -> DataFrame:
    """(task, attempt, capture, state): claimed by one capture, or refused because several claim it."""
    g = captures.where(F.col(task).isNotNull() & F.col(attempt).isNotNull()).groupBy(task, attempt).agg(F.count("*").alias("n"), F.min(ident).alias("capture"))
    return g.select(task, attempt, F.when(F.col("n") == 1, F.col("capture")).alias("capture"), F.when(F.col("n") == 1, "claimed").otherwise("refused").alias("state"))


def repetition_order(tasks: DataFrame, task: str, position: str, repetitions: int) -> DataFrame:
    """(turn, repetition, task): all tasks once, then all again: turns follow from positions, without a sort in one task.

    position: 0 to n - 1 without gaps.
    """
    n = tasks.count()
    rep = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition")
    return tasks.select(task, position, rep).select((F.col("repetition") * n + F.col(position)).cast("long").alias("turn"), "repetition", task)


def calibration_summary(pairs: DataFrame, key: list[str], actual: str, band: str) -> DataFrame:
    """key, n, max_deviation, coverage80, flagged: shares of actuals under the nine quantiles against their levels.

    flagged: a share is off by more than two standard errors. Rows without a band or an actual are left out.
    """
    rows = pairs.where(F.col(actual).isNotNull() & F.col(band).isNotNull())
    under = [F.avg((F.col(actual) <= F.element_at(band, k + 1)).cast("double")) for k in range(len(LEVELS))]
    off = [F.abs(u - level) for u, level in zip(under, LEVELS, strict=True)]
    bound = [2.0 * F.sqrt(F.lit(level * (1 - level)) / F.count("*")) for level in LEVELS]
    inside = F.col(actual).between(F.element_at(band, 1), F.element_at(band, len(LEVELS)))
    flags = [o > b for o, b in zip(off, bound, strict=True)]
    anyone = flags[0]
    for f in flags[1:]:
        anyone = anyone | f
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.greatest(*off).alias("max_deviation"), F.avg(inside.cast("double")).alias("coverage80"), anyone.alias("flagged"))


def scenario_faults(paths: DataFrame, columns: DataFrame, horizon: int, target: str) -> DataFrame:
    """(scenario, column, fault) of declared future paths(scenario, column, values) that can't be run.

    Faults: unknown_column, is_target, not_declarable, wrong_length, hole, not_finite, negative (of a count), repeated.
    columns: column, declarable, count (whether it is a number of things).
    """
    n = paths.groupBy("scenario", "column").agg(F.count("*").alias("times"), F.first("values").alias("values"))
    c = n.join(F.broadcast(columns), "column", "left")
    bad = lambda f: F.exists("values", f)
    faults = F.array_compact(F.array(
        F.when(F.col("declarable").isNull() & (F.col("column") != target), "unknown_column"), F.when(F.col("column") == target, "is_target"), F.when(~F.col("declarable"), "not_declarable"),
        F.when(F.size("values") != horizon, "wrong_length"), F.when(bad(lambda x: x.isNull()), "hole"), F.when(bad(lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite"),
        F.when(F.col("count") & bad(lambda x: x < 0), "negative"), F.when(F.col("times") > 1, "repeated"),
    ))
    return c.select("scenario", "column", F.explode(faults).alias("fault"))


def regime_state(regimes: DataFrame, key: str, pooled: bool = False) -> DataFrame:
    """(key, regimes, state): a series of several regimes is refused, unless it may be pooled."""
    g = regimes.groupBy(key).agg(F.count_distinct("regime").alias("regimes"))
    return g.withColumn("state", F.when(F.col("regimes") <= 1, "ok").otherwise("pooled" if pooled else "refused"))


def advisory(targets: DataFrame, runs: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One record a target: readiness, the newest run's label, its calibration, and what stands against using it.

    targets: target, ready; runs: target, made_at, run_id, label; calibrated: run_id, flagged.
    """
    newest = runs.groupBy("target").agg(F.max_by(F.struct("run_id", "label"), F.struct("made_at", "run_id")).alias("r"))
    rows = targets.join(newest, "target", "left").select("target", "ready", F.col("r.run_id").alias("run_id"), F.col("r.label").alias("label")).join(calibrated, "run_id", "left")
    against = F.array_compact(F.array(
        F.when(~F.col("ready"), "not_ready"), F.when(F.col("run_id").isNull(), "no_run"), F.when(F.col("label") != "model_adds", "label"), F.when(F.col("flagged"), "calibration"),
    ))
    return rows.select("target", "ready", "run_id", "label", F.array_join(against, ",").alias("against"), (F.size(against) == 0).alias("usable"))


def fold_summary(folds: DataFrame, key: str, score: str, baseline: str, margin: float) -> DataFrame:
    """(key, folds, mean_gain, wins, label) of per-fold scores against a baseline (both: lower is better).

    label: adds if the mean gain clears the margin and every fold wins, mixed if only one holds, else no_gain.
    """
    gain = 1 - F.col(score) / F.col(baseline)
    g = folds.where(F.col(baseline) > 0).groupBy(key).agg(F.count("*").alias("folds"), F.avg(gain).alias("mean_gain"), F.count_if(gain > 0).alias("wins"))
    clears, every = F.col("mean_gain") >= margin, F.col("wins") == F.col("folds")
    return g.withColumn("label", F.when(clears & every, "adds").when(clears | every, "mixed").otherwise("no_gain"))


def first_binding(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, ended): the first stated value binds a capture for good; ended: whether an end came after it."""
    first = F.min_by(F.struct(F.col(order).alias("at"), F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col(order)))
    g = rows.groupBy(key).agg(first.alias("f"), F.max(F.when(F.col("end"), F.col(order))).alias("last_end"))
    return g.select(key, F.col("f.v").alias(value), F.coalesce(F.col("last_end") > F.col("f.at"), F.lit(False)).alias("ended"))


def dry_run(files: DataFrame, stored: DataFrame, grouping: str, since: str | None = None, project: str | None = None) -> DataFrame:
    """(group, files, stored, new, unreadable) of an import that is only looked at.

    files: path, first_ts (null: unreadable), capture_id. grouping: project (the path's first part) or day. since: files whose
    first event is older are left out, unreadable ones stay; project: only that first part.
    """
    part = F.substring_index("path", "/", 1)
    rows = files.where(part == project) if project else files
    rows = rows.where(F.col("first_ts").isNull() | (F.to_date("first_ts") >= since)) if since else rows
    group = part if grouping == "project" else F.coalesce(F.date_format("first_ts", "yyyy-MM-dd"), F.lit("unknown"))
    known = stored.select("capture_id").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "capture_id", "left").withColumn("group", group)
    readable, kept = F.col("first_ts").isNotNull(), F.col("known").isNotNull()
    return rows.groupBy("group").agg(
        F.count("*").alias("files"), F.count_if(readable & kept).alias("stored"), F.count_if(readable & ~kept).alias("new"), F.count_if(~readable).alias("unreadable")
    )


def replay_order(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Recorded posts by their ingest time, then raw lines by file and line: (phase, at, file, line, body), in that order."""
    a = records.select(F.lit(0).alias("phase"), "at", "file", "line", "body")
    b = lines.select(F.lit(1).alias("phase"), F.lit(None).cast("double").alias("at"), "file", "line", "body")
    return a.unionByName(b).orderBy("phase", "at", "file", "line")


def passthrough(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One activity for each observation of the named kinds, with who made it: ours by its type, else external."""
    actor = F.when(F.col("type").startswith("tidemark."), "tidemark").otherwise("external")
    return rows.where(F.col("kind").isin(*kinds)).select("capture_id", "observation_id", "kind", actor.alias("actor"), "payload")


def lifecycle(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position, event) with the ordinal of each lifecycle event within its capture."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.where("event is not null").select(key, F.col(order), "event", n.alias("ordinal"))
