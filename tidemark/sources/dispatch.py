"""Mixed surfaces in one pass: bodies of any provider and surface as VARIANT, routed to their parsers, with a letter for each that can't be read.

A body becomes a list of observations, one struct each, chosen by its provider and surface in one projection, so the table is
read once however many surfaces it mixes. Access is tolerant: what isn't of the expected shape is skipped, and a body
of which nothing is left, or that isn't an object, is a letter that says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fresh_tokens, snake

OBSERVATION = "array<struct<session:string,kind:string,at:timestamp_ntz,payload:map<string,string>>>"
#: fixed values: surfaces of the providers
SURFACES = {
    "claude": ("otel_logs", "otel_metrics", "hook", "stream", "transcript"),
    "codex": ("otel_logs", "otel_metrics", "hook", "exec_json", "stream", "rollout"),
}
POINT_KINDS = ("sum", "gauge", "histogram", "exponentialHistogram", "summary")
SESSION_KEYS = ("session.id", "conversation.id", "session_id")
DETAIL = 2048


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def objects(v: Column, path: str) -> Column:
    """The objects of a list at a path; anything else in it is skipped, and what is no list is empty."""
    items = F.coalesce(get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(items, lambda x: F.substring(F.to_json(x), 1, 1) == "{")


def stated(**columns: Column) -> Column:
    """A map of the columns that aren't null, as text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def attributes(v: Column, path: str) -> Column:
    """A list of keys and typed values as a map of texts; of a repeated key the last one stays."""
    value = lambda a: F.coalesce(*[get(a, f"$.value.{k}") for k in ("stringValue", "intValue", "doubleValue", "boolValue")])
    pairs = F.filter(F.transform(objects(v, path), lambda a: F.struct(get(a, "$.key").alias("key"), value(a).alias("value"))), lambda p: p["key"].isNotNull())
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))


def _observation(session: Column, kind: Column, at: Column, payload: Column) -> Column:
    return F.struct(session.alias("session"), kind.alias("kind"), at.cast("timestamp_ntz").alias("at"), payload.alias("payload"))


def _nanos(text: Column) -> Column:
    n = text.try_cast("long")
    return F.when(n > 0, F.timestamp_micros(F.floor(n / 1000).cast("long")))


def _stamp(v: Column, path: str) -> Column:
    return F.try_to_timestamp(get(v, path))


def _own_session(known: Column) -> Column:
    return F.coalesce(*[F.try_element_at(known, F.lit(k)) for k in SESSION_KEYS])


def _units(v: Column, outer: str, inner: str, make) -> Column:
    """make(resource's attributes, unit) of every unit of ``inner`` below every scope of every resource."""
    scope = {"resourceLogs": "scopeLogs", "resourceMetrics": "scopeMetrics"}[outer]
    per_scope = lambda r: F.flatten(F.transform(objects(r, f"$.{scope}"), lambda s: F.transform(objects(s, f"$.{inner}"), lambda u: make(attributes(r, "$.resource.attributes"), u))))
    return F.flatten(F.transform(objects(v, f"$.{outer}"), per_scope))


def otel_logs(v: Column, provider: str) -> Column:
    """One observation for each log record, named by its event."""

    def record(resource: Column, u: Column) -> Column:
        own = attributes(u, "$.attributes")
        name = F.coalesce(F.try_element_at(own, F.lit("event.name")), get(u, "$.body.stringValue"), F.lit("unnamed"))
        rest = F.map_filter(own, lambda k, _: ~k.isin("event.name", *SESSION_KEYS))
        return _observation(F.coalesce(_own_session(own), _own_session(resource)), F.concat(F.lit(f"{provider}.otel."), name), _nanos(F.coalesce(get(u, "$.timeUnixNano"), get(u, "$.observedTimeUnixNano"))), rest)

    return _units(v, "resourceLogs", "logRecords", record)


def otel_metrics(v: Column, provider: str) -> Column:
    """One observation for each data point of any aggregation."""

    def points(resource: Column, m: Column) -> Column:
        def point(kind: str):
            def of(p: Column) -> Column:
                own = attributes(p, "$.attributes")
                value = F.coalesce(get(p, "$.asDouble", "double"), get(p, "$.asInt").try_cast("double"), get(p, "$.sum", "double"))
                told = stated(unit=get(m, "$.unit"), aggregation=F.lit(kind), value=value)
                return _observation(F.coalesce(_own_session(own), _own_session(resource)), F.concat(F.lit(f"{provider}.metric."), F.coalesce(get(m, "$.name"), F.lit("unnamed"))), _nanos(get(p, "$.timeUnixNano")), told)

            return of

        return F.flatten(F.array(*[F.transform(objects(m, f"$.{kind}.dataPoints"), point(kind)) for kind in POINT_KINDS]))

    return F.flatten(_units(v, "resourceMetrics", "metrics", points))


def hook(v: Column, provider: str) -> Column:
    """One observation; a body that doesn't name its event gives none. Hooks carry no time."""
    name = get(v, "$.hook_event_name")
    told = stated(tool=get(v, "$.tool_name"), tool_use_id=get(v, "$.tool_use_id"), cwd=get(v, "$.cwd"), mode=get(v, "$.permission_mode"), effort=get(v, "$.effort.level"), reason=get(v, "$.reason"))
    one = _observation(get(v, "$.session_id"), F.concat(F.lit(f"{provider}.hook."), snake(name)), F.lit(None), told)
    return F.when(name.isNotNull(), F.array(one))


def _usage(v: Column, path: str) -> dict[str, Column]:
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}
    return {k: get(v, f"{path}.{n}", "bigint") for k, n in names.items()}


def _message(v: Column, provider: str, surface: str, session: Column, at: Column, **more: Column) -> Column:
    """The line itself, then one observation for each call and each result among its blocks, without their content."""
    kind = F.concat_ws(".", F.lit(f"{provider}.{surface}"), get(v, "$.type"), get(v, "$.subtype"))
    blocks = objects(v, "$.message.content")
    count = lambda name: F.when(get(v, "$.message.content", "array<variant>").isNotNull(), F.size(F.filter(blocks, lambda b: get(b, "$.type") == name)))
    line = stated(model=get(v, "$.message.model"), text_blocks=count("text"), thinking_blocks=count("thinking"), **_usage(v, "$.message.usage"), **more)

    def block(b: Column) -> Column:
        what = get(b, "$.type")
        told = stated(call=F.coalesce(get(b, "$.id"), get(b, "$.tool_use_id")), name=get(b, "$.name"), is_error=get(b, "$.is_error", "boolean"))
        return _observation(session, F.concat(F.lit(f"{provider}.{surface}."), what), at, told)

    calls = F.transform(F.filter(blocks, lambda b: get(b, "$.type").isin("tool_use", "tool_result")), block)
    return F.when(get(v, "$.type").isNotNull(), F.concat(F.array(_observation(session, kind, at, line)), calls))


def stream(v: Column, provider: str) -> Column:
    return _message(v, provider, "stream", get(v, "$.session_id"), F.lit(None).cast("timestamp"), parent=get(v, "$.parent_tool_use_id"), cost=get(v, "$.total_cost_usd", "double"), turns=get(v, "$.num_turns", "bigint"))


def transcript(v: Column, provider: str) -> Column:
    more = {"uuid": get(v, "$.uuid"), "parent": get(v, "$.parentUuid"), "sidechain": get(v, "$.isSidechain", "boolean"), "request": get(v, "$.requestId"), "version": get(v, "$.version"), "branch": get(v, "$.gitBranch"), "cwd": get(v, "$.cwd")}
    return _message(v, provider, "transcript", get(v, "$.sessionId"), _stamp(v, "$.timestamp"), **more)


def exec_json(v: Column, provider: str) -> Column:
    """An item by its phase and type, with one more observation for each changed file (a list of objects or a map by path), or a turn's totals."""
    total, cached = get(v, "$.usage.input_tokens", "bigint"), get(v, "$.usage.cached_input_tokens", "bigint")
    session = get(v, "$.thread_id")
    told = stated(id=get(v, "$.item.id"), command=get(v, "$.item.command"), exit_code=get(v, "$.item.exit_code", "bigint"), status=get(v, "$.item.status"), fresh=fresh_tokens(total, cached), cached=cached, output=get(v, "$.usage.output_tokens", "bigint"))
    line = _observation(session, F.concat_ws(".", F.lit(f"{provider}.exec"), get(v, "$.type"), get(v, "$.item.type")), F.lit(None), told)
    file = lambda path, kind: _observation(session, F.lit(f"{provider}.exec.file"), F.lit(None), stated(item=get(v, "$.item.id"), path=path, change=kind))
    listed = F.transform(objects(v, "$.item.changes"), lambda c: file(get(c, "$.path"), get(c, "$.kind")))
    keyed = F.transform(F.map_entries(get(v, "$.item.changes", "map<string,variant>")), lambda e: file(e["key"], get(e["value"], "$.kind")))
    keep = get(v, "$.type").isNotNull() & (F.coalesce(get(v, "$.item.type"), F.lit("")) != "reasoning")
    return F.when(keep, F.concat(F.array(line), listed, F.coalesce(keyed, F.expr(f"cast(array() as {OBSERVATION})"))))


def rollout(v: Column, provider: str) -> Column:
    last = "$.payload.info.last_token_usage"
    total, cached = get(v, f"{last}.input_tokens", "bigint"), get(v, f"{last}.cached_input_tokens", "bigint")
    told = stated(id=get(v, "$.payload.id"), turn=get(v, "$.payload.turn_id"), call=get(v, "$.payload.call_id"), model=get(v, "$.payload.model"), cwd=get(v, "$.payload.cwd"), fresh=fresh_tokens(total, cached), cached=cached, output=get(v, f"{last}.output_tokens", "bigint"))
    session = F.coalesce(get(v, "$.session_id"), F.when(get(v, "$.type") == "session_meta", get(v, "$.payload.id")))
    one = _observation(session, F.concat_ws(".", F.lit(f"{provider}.rollout"), get(v, "$.type"), get(v, "$.payload.type")), _stamp(v, "$.timestamp"), told)
    keep = get(v, "$.type").isNotNull() & (F.coalesce(get(v, "$.payload.type"), F.lit("")) != "reasoning")
    return F.when(keep, F.array(one))


def _parser(provider: str, surface: str):
    # a provider's exec lines come under two names
    if provider == "codex" and surface in ("exec_json", "stream"):
        return exec_json
    return {"otel_logs": otel_logs, "otel_metrics": otel_metrics, "hook": hook, "stream": stream, "transcript": transcript, "rollout": rollout}[surface]


def dispatch(rows: DataFrame, body: str = "body", provider: str = "provider", surface: str = "surface") -> DataFrame:
    """rows without their body, one for each observation, with n, session, kind, at, payload, or one letter with why and detail.

    n counts a body's observations from 0. Letters have a null kind and why: ``surface`` (none of SURFACES), ``json`` (unreadable, or a key twice in one
    object), ``no_object``, or ``empty`` (nothing in it is an observation); a null body is unreadable. Every row of the input gives at least one row.
    """
    keep = [c for c in rows.columns if c != body]
    read = rows.withColumn("__v", F.try_parse_json(F.col(body).cast("string")))
    none = F.expr(f"cast(array() as {OBSERVATION})")
    chosen, known = none, F.lit(False)
    for p, surfaces in SURFACES.items():
        for s in surfaces:
            own = (F.col(provider) == p) & (F.col(surface) == s)
            known = known | own
            chosen = F.when(own, F.coalesce(_parser(p, s)(F.col("__v"), p).cast(OBSERVATION), none)).otherwise(chosen)
    shape = F.substring(F.to_json("__v"), 1, 1)
    early = F.when(~F.coalesce(known, F.lit(False)), "surface").when(F.col("__v").isNull(), "json").when(shape != "{", "no_object")
    made = read.withColumn("__early", early).withColumn("__all", F.when(F.col("__early").isNull(), chosen).otherwise(none))
    why = F.coalesce("__early", F.when(F.size("__all") == 0, "empty"))
    told = made.select(*keep, why.alias("why"), F.when(why.isNotNull(), F.substring(F.col(body).cast("string"), 1, DETAIL)).alias("detail"), F.posexplode_outer("__all").alias("n", "__o"))
    return told.select(*keep, "n", "__o.session", "__o.kind", "__o.at", "__o.payload", "why", "detail")


def split_letters(found: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(observations, letters) of what ``dispatch`` gives."""
    return found.where("why is null").drop("why", "detail"), found.where("why is not null").select(*keep, "why", "detail")
