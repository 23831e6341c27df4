"""OTLP JSON: logs and metrics unnested to rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,body:{VALUE},attributes:{ATTRS}>>>>>>>"
POINT = f"array<struct<attributes:{ATTRS},timeUnixNano:string,asDouble:double,asInt:string,sum:double,count:string>>"
METRIC = f"struct<name:string,unit:string,sum:struct<dataPoints:{POINT}>,gauge:struct<dataPoints:{POINT}>,histogram:struct<dataPoints:{POINT}>,exponentialHistogram:struct<dataPoints:{POINT}>,summary:struct<dataPoints:{POINT}>>"
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{ATTRS}>,scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>>"


def any_value(v: Column) -> Column:
    """The one stated variant as text."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def value_json(text: Column) -> Column:
    """A value's JSON text as canonical JSON of what it stands for: lists and key lists nested to any depth.

    Whole numbers may be text; what doesn't convert stays text. Null, unreadable and unknown variants are null. Any depth
    needs recursion, which Column functions don't have: a small Arrow-batched function.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def of(v):
            if not isinstance(v, dict):
                return None
            if "intValue" in v:
                try:
                    return int(v["intValue"])
                except (TypeError, ValueError):
                    return v["intValue"]
            for k in ("stringValue", "doubleValue", "boolValue"):
                if k in v:
                    return v[k]
            if "arrayValue" in v:
                return [of(x) for x in (v["arrayValue"] or {}).get("values") or []]
            if "kvlistValue" in v:
                return {x["key"]: of(x.get("value")) for x in (v["kvlistValue"] or {}).get("values") or [] if isinstance(x, dict) and "key" in x}
            return None

        def one(t):
            try:
                v = of(json.loads(t))
            except (TypeError, ValueError):
                return None
            return None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        return texts.map(one)

    return run(text)


def attributes(attrs: Column) -> Column:
    """An attribute list as a map; of a repeated key the last one stays."""
    keys = F.array_distinct(F.transform(attrs, lambda a: a["key"]))
    last = lambda k: F.element_at(F.filter(attrs, lambda a: a["key"] == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: any_value(last(k)["value"])))


def nanos(text: Column) -> Column:
    """A timestamp without zone from nanoseconds as text; zero is unknown."""
    n = text.try_cast("long")
    return F.when(n > 0, F.timestamp_micros(F.floor(n / 1000).cast("long")))


def log_records(bodies: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per log record of JSON bodies, with the resource's attributes; bodies that don't parse give none."""
    parsed = bodies.select(*keep, F.from_json(body, LOGS).alias("b"))
    r = parsed.select(*keep, F.explode("b.resourceLogs").alias("r"))
    s = r.select(*keep, F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
    x = s.select(*keep, "ra", F.explode("s.logRecords").alias("x"))
    return x.select(*keep, attributes(F.col("ra")).alias("resource"), attributes(F.col("x.attributes")).alias("attributes"), any_value(F.col("x.body")).alias("body"), F.coalesce(F.col("x.timeUnixNano"), F.col("x.observedTimeUnixNano")).alias("time_nanos"))


def _tagged(kind: str) -> Column:
    points = F.coalesce(F.col(f"m.{kind}.dataPoints"), F.expr(f"cast(array() as {POINT})"))
    return F.transform(points, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))


def metric_points(bodies: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per data point of any of the five aggregation kinds."""
    kinds = ("sum", "gauge", "histogram", "exponentialHistogram", "summary")
    parsed = bodies.select(*keep, F.from_json(body, METRICS).alias("b"))
    r = parsed.select(*keep, F.explode("b.resourceMetrics").alias("r"))
    s = r.select(*keep, F.explode("r.scopeMetrics").alias("s"))
    m = s.select(*keep, F.explode("s.metrics").alias("m"))
    points = F.flatten(F.array(*[_tagged(k) for k in kinds]))
    x = m.select(*keep, F.col("m.name").alias("name"), F.explode(points).alias("x"))
    return x.select(*keep, "name", "x.kind", attributes(F.col("x.p.attributes")).alias("attributes"), F.coalesce(F.col("x.p.asDouble"), F.col("x.p.asInt").try_cast("double"), F.col("x.p.sum")).alias("value"))
