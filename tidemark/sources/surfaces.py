"""Recorded surfaces as observations: (session, kind, at, payload map) from hook, stream, exec and rollout lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOOK = "session_id string, cwd string, hook_event_name string, tool_name string, tool_use_id string, permission_mode string"
ITEM = "struct<id:string,type:string,command:string,exit_code:int,status:string>"
EXEC = f"type string, thread_id string, item {ITEM}, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"
ROLLOUT = "timestamp string, type string, payload struct<type:string,id:string,info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>>>"
RESULT = "type string, session_id string, modelUsage map<string,struct<contextWindow:bigint,outputTokens:bigint>>"


def _stated(**columns: Column) -> Column:
    """A map of the columns that aren't null, as text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def hooks(lines: DataFrame, body: str = "value") -> DataFrame:
    """Hook bodies; they carry no event time."""
    p = lines.withColumn("p", F.from_json(body, HOOK)).where("p.hook_event_name is not null")
    from ..functions.scalars import snake

    return p.select(F.col("p.session_id").alias("session"), F.concat(F.lit("hook."), snake(F.col("p.hook_event_name"))).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("at"), _stated(tool=F.col("p.tool_name"), tool_use_id=F.col("p.tool_use_id"), cwd=F.col("p.cwd"), mode=F.col("p.permission_mode")).alias("payload"))


def exec_lines(lines: DataFrame, body: str = "value") -> DataFrame:
    """Exec lines: items by phase and type, and turn totals; fresh input only where it is known and not negative."""
    from ..functions.scalars import fresh_tokens

    p = lines.withColumn("p", F.from_json(body, EXEC)).where("p.type is not null and coalesce(p.item.type, '') != 'reasoning'")
    u = F.col("p.usage")
    payload = _stated(id=F.col("p.item.id"), command=F.col("p.item.command"), exit_code=F.col("p.item.exit_code"), status=F.col("p.item.status"), fresh=fresh_tokens(u["input_tokens"], u["cached_input_tokens"]), output=u["output_tokens"])
    return p.select(F.col("p.thread_id").alias("session"), F.concat_ws(".", F.lit("exec"), F.col("p.type"), F.col("p.item.type")).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("at"), payload.alias("payload"))


def rollout_lines(lines: DataFrame, session: str, body: str = "value") -> DataFrame:
    p = lines.withColumn("p", F.from_json(body, ROLLOUT)).where("p.type is not null and coalesce(p.payload.type, '') != 'reasoning'")
    u = F.col("p.payload.info.last_token_usage")
    return p.select(F.col(session).alias("session"), F.concat_ws(".", F.lit("rollout"), F.col("p.type"), F.col("p.payload.type")).alias("kind"), F.try_to_timestamp(F.col("p.timestamp")).cast("timestamp_ntz").alias("at"), _stated(id=F.col("p.payload.id"), input=u["input_tokens"], cached=u["cached_input_tokens"], output=u["output_tokens"]).alias("payload"))


def session_totals(lines: DataFrame, body: str = "value") -> DataFrame:
    """Of each session's result lines: the largest context window, the models in order, and the output of all models."""
    p = lines.withColumn("p", F.from_json(body, RESULT)).where("p.type = 'result'")
    usage = F.col("p.modelUsage")
    rows = p.select(
        F.col("p.session_id").alias("session"), F.array_max(F.transform(F.map_values(usage), lambda v: v["contextWindow"])).alias("context_window"), F.array_sort(F.map_keys(usage)).alias("models"),
        F.aggregate(F.transform(F.map_values(usage), lambda v: v["outputTokens"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("output"),
    )
    return rows.groupBy("session").agg(F.max("context_window").alias("context_window"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))), ",").alias("models"), F.max("output").alias("output"))


def by_key_set(df: DataFrame, payload: str, shapes: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with ``shape``: the one whose keys are exactly the payload's; null for none."""
    keys = F.array_join(F.array_sort(F.map_keys(payload)), "\x1f")
    table = F.create_map(*[F.lit(x) for name, names in shapes.items() for x in ("\x1f".join(sorted(names)), name)])
    return df.withColumn("shape", F.try_element_at(table, keys))


def session_hint(body: str) -> Column:
    """The session of a body under any of its spellings, without parsing the rest."""
    return F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in ("session_id", "sessionId", "thread_id", "payload.id")])
