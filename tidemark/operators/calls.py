"""Tool calls and requests: types, outcomes, ids, commands, token counts and their attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of tools, item kinds, shells and categories of verification
READ_TOOLS = ("Read", "Glob", "Grep", "NotebookRead")
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
COMMAND_TOOLS = ("Bash", "BashOutput")
PATCH_TOOLS, PATCH_ITEMS = ("apply_patch",), ("file_change",)
READ_HEADS = ("cat", "sed", "rg", "grep", "ls", "find", "head", "tail")
SEARCH_TOOLS, SEARCH_HEADS = ("Grep", "Glob"), ("rg", "grep", "find")
SEPARATORS = ("&&", "||", ";", "|")
SHELLS = ("sh", "bash", "zsh", "dash", "ksh")
USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
EXECUTION = "exec-"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def tool_type(name: Column, category: Column, refused: Column, verification: tuple[str, ...]) -> Column:
    """The narrowest of five types; a refused call is no more than a call."""
    return (
        F.when(_yes(refused), "tool_call").when(category.isin(*verification), "verification_run").when(name.isin(*EDIT_TOOLS), "file_edit")
        .when(name.isin(*READ_TOOLS), "file_read").when(name.isin(*COMMAND_TOOLS) | category.isNotNull(), "command").otherwise("tool_call")
    )


def heads(command: Column) -> Column:
    """The first word of each segment of a command in normal form; flags in front of it don't count."""
    segments = F.split(F.concat(F.lit(" "), command, F.lit(" ")), r" (?:&&|\|\||;|\|)(?= )")
    first = lambda s: F.filter(F.split(F.trim(s), " +"), lambda w: (w != "") & ~w.startswith("-"))
    return F.filter(F.transform(segments, lambda s: F.try_element_at(first(s), F.lit(1))), lambda h: h.isNotNull())


def item_type(name: Column, item: Column, category: Column, command: Column, verification: tuple[str, ...]) -> Column:
    """The type of a call that states an item kind: patches edit, shell commands that read are reads."""
    reads = (category == "shell") & F.arrays_overlap(heads(F.coalesce(command, F.lit(""))), F.array(*map(F.lit, READ_HEADS)))
    return (
        F.when(_yes(name.isin(*PATCH_TOOLS)) | _yes(item.isin(*PATCH_ITEMS)), "file_edit").when(category.isin(*verification), "verification_run")
        .when(reads, "file_read").when(category.isNotNull(), "command").otherwise("tool_call")
    )


def outcome(denied: Column, success: Column, failure_event: Column, is_error: Column, masked: Column) -> Column:
    """struct(outcome, executed, exit_masked, success): a refusal decides alone; else the first surface that tells.

    success: as stated, else false by a failure event, else by the absence of an error flag, else unknown.
    """
    no = _yes(denied)
    told = F.coalesce(success, F.when(_yes(failure_event), False), ~is_error)
    return F.struct(
        F.when(no, "refused").otherwise("executed").alias("outcome"), (~no).alias("executed"),
        F.when(~no & _yes(masked), True).alias("exit_masked"), F.when(~no, told).alias("success"),
    )


def exit_outcome(success: Column, exit_code: Column) -> Column:
    """success as stated, else by the exit code."""
    return F.coalesce(success, exit_code == 0)


def outcome_word(exit_code: Column, success: Column, is_error: Column, masked: Column) -> Column:
    """ok or failed for a timeline: the exit code first, then success, then the error flag; with a remark where masked."""
    good = F.coalesce(exit_code == 0, success, ~is_error)
    word = F.when(good, "ok").when(~good, "failed")
    return F.when(_yes(masked), F.coalesce(F.concat(word, F.lit(", check masked")), F.lit("check masked"))).otherwise(word)


def execution_id(*names: Column) -> Column:
    """The first non-empty of an execution's names, if it is one of an execution."""
    found = F.coalesce(*[F.when(n != "", n) for n in names])
    return F.when(found.startswith(EXECUTION), found)


def by_execution(rows: DataFrame, names: list[str], keep: list[Column]) -> DataFrame:
    """rows grouped by capture and execution id, whichever of its names a row has; rows without one are left out."""
    return rows.withColumn("execution", execution_id(*map(F.col, names))).where("execution is not null").groupBy("capture_id", "execution").agg(*keep)


def unshell(command: Column) -> Column:
    """The script of ``<shell> -lc '<script>'``; other commands as they are."""
    found = F.regexp_extract(command, rf"""^\s*(?:\S*/)?(?:{"|".join(SHELLS)})\s+-[a-z]*c\s+(?:'([^']*)'|"([^"$`\\]*)"|([^\s'"]+))\s*$""", 1)
    for group in (2, 3):
        more = F.regexp_extract(command, rf"""^\s*(?:\S*/)?(?:{"|".join(SHELLS)})\s+-[a-z]*c\s+(?:'([^']*)'|"([^"$`\\]*)"|([^\s'"]+))\s*$""", group)
        found = F.when(found != "", found).otherwise(more)
    return F.when(command.isNull(), None).when(found != "", found).otherwise(command)


def renormalise(command: Column) -> Column:
    """The token rules applied to a stored normal form: tokens are kept, cut or replaced by ``_``, so a second pass changes nothing."""
    outside = lambda t: F.concat(F.lit("<outside>/"), F.substring(F.sha2(t, 256), 1, 8))
    assigned = lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")

    def token(t: Column, head: Column) -> Column:
        flag = F.when(t.rlike(r"^--?[A-Za-z0-9][\w-]*(=|$)"), F.substring_index(t, "=", 1)).otherwise(F.lit("_"))
        return (
            F.when(t.isin(*SEPARATORS) | (t == "_") | t.startswith("<outside>/"), t).when(t.startswith("-"), flag)
            .when(assigned(t), F.concat(F.substring_index(t, "=", 1), F.lit("="))).when(t.startswith("/"), outside(t))
            .when(head | t.contains("/") | t.rlike(r"^[a-z][a-z0-9_-]{0,31}$"), t).otherwise(F.lit("_"))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("head"))
    step = lambda s, t: F.struct(F.array_append(s["out"], token(t, s["head"])).alias("out"), (t.isin(*SEPARATORS) | (s["head"] & assigned(t))).alias("head"))
    words = F.filter(F.split(command, r"\s+"), lambda t: t != "")
    return F.array_join(F.aggregate(words, start, step, lambda s: s["out"]), " ")


def duration_ms(secs: Column, nanos: Column) -> Column:
    """Whole milliseconds of {secs, nanos}; null if either is unknown."""
    return secs.cast("long") * 1000 + F.floor(nanos / 1_000_000).cast("long")


def whole(text: Column) -> Column:
    """A whole number from text, or null: signs and digits only."""
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("long"))


def number(text: Column) -> Column:
    """A finite number from text, or null."""
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def text_or_null(text: Column) -> Column:
    return F.when(text != "", text)


def typed_number(text: Column, kind: Column) -> Column:
    """A size as a number, anything else as unknown."""
    return F.when(kind == "size", number(text))


def usage(rows_first: Column, second: Column) -> Column:
    """A counter that surfaces spell in two ways; the first spelling wins."""
    return F.coalesce(rows_first, second)


def output_tokens(rows: DataFrame, key: list[str], order: list[str], silent: Column, count: Column) -> DataFrame:
    """key, output_tokens: the first count of a surface that states one; snapshot: the first one of the surface that doesn't."""
    place = F.struct(*order)
    stated, other = count.isNotNull() & ~_yes(silent), count.isNotNull() & _yes(silent)
    return rows.groupBy(*key).agg(F.min_by(count, F.when(stated, place)).alias("output_tokens"), F.min_by(count, F.when(other, place)).alias("snapshot"))


def unit_value(value: Column, unit: Column) -> Column:
    """A stored real in its unit, as text: whole unless a ratio or milliseconds."""
    return F.when(unit.isin("ratio", "ms"), value.cast("string")).otherwise(F.round(value).cast("long").cast("string"))


def is_search(tool: Column, command: Column) -> Column:
    """A search by a tool, or by a command with the word of one."""
    return _yes(tool.isin(*SEARCH_TOOLS)) | _yes(F.arrays_overlap(F.split(command, " "), F.array(*map(F.lit, SEARCH_HEADS))))


def agent_of(name: Column, source: Column) -> Column:
    """The subagent of a request: its name, else the last part of an ``agent:`` source."""
    return F.coalesce(F.when(name != "", name), F.when(source.startswith("agent:"), F.substring_index(source, ":", -1)))


def attributed(requests: DataFrame, agents: DataFrame, counters: tuple[str, ...] = USAGE) -> DataFrame:
    """agents(capture_id, agent_type) with the requests that their type made: attributed_requests, one sum a counter and the total.

    A counter that no request states is null; agents without requests have nothing attributed. Requests are added up
    by capture and agent before the join, so that a busy agent is one row in it.
    """
    sums = requests.where("agent is not null").groupBy("capture_id", F.col("agent").alias("agent_type")).agg(
        F.count("*").alias("attributed_requests"), *[F.sum(c).alias(f"attributed_{c}") for c in counters]
    )
    total = sum((F.coalesce(F.col(f"attributed_{c}"), F.lit(0)) for c in counters[1:]), F.coalesce(F.col(f"attributed_{counters[0]}"), F.lit(0)))
    joined = agents.join(sums, ["capture_id", "agent_type"], "left")
    return joined.withColumn("attributed_total", F.when(F.col("attributed_requests").isNotNull(), total))


def subagent_tokens(agents: DataFrame) -> DataFrame:
    """capture_id, subagent_tokens, coverage: the sum over a capture's agents; partial if one has nothing attributed, null if all have."""
    missing = F.count_if(F.col("attributed_total").isNull())
    word = F.when(missing == F.count("*"), "unavailable").when(missing > 0, "partial").otherwise("observed")
    return agents.groupBy("capture_id").agg(F.sum("attributed_total").alias("subagent_tokens"), word.alias("coverage"))


def total_or_session(requests: DataFrame, key: str, count: Column, session_total: DataFrame) -> DataFrame:
    """key, output_tokens, coverage: the sum if every request states one, else the session's own total (partial), else null.

    session_total: key, position, total; the last row of a session is its total.
    """
    last = session_total.groupBy(key).agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("position"))).alias("total"))
    sums = requests.groupBy(key).agg(F.when(F.bool_and(count.isNotNull()), F.sum(count)).alias("own"))
    word = F.when(F.col("own").isNotNull(), "observed").when(F.col("total").isNotNull(), "partial").otherwise("unavailable")
    return sums.join(last, key, "left").select(key, F.coalesce("own", "total").alias("output_tokens"), word.alias("coverage"))


def turn_totals(rows: DataFrame, key: list[str], kind: str, order: str, counters: list[str], final: str, running: str) -> DataFrame:
    """key, usage_source and the counters of the last ``final`` row, else of the last ``running`` one."""
    cells = F.struct(*counters)
    last = lambda k: F.max_by(cells, F.when(F.col(kind) == k, F.col(order)))
    found = rows.groupBy(*key).agg(last(final).alias("a"), last(running).alias("b"), F.bool_or(F.col(kind) == final).alias("has_a"), F.bool_or(F.col(kind) == running).alias("has_b"))
    pick = lambda c: F.when(F.col("has_a"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return found.select(*key, F.when(F.col("has_a"), final).when(F.col("has_b"), running).alias("usage_source"), *map(pick, counters))
