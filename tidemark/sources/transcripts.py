"""JSON-lines sources: tolerant parsing, content counts, file surveys and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "struct<type:string,id:string,tool_use_id:string,name:string,is_error:boolean,text:string>"
LINE = f"type string, sessionId string, uuid string, timestamp string, message struct<role:string,model:string,content:array<{BLOCK}>>, _corrupt string"


def parse_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of JSON lines: a bad line costs itself only."""
    parsed = lines.withColumn("p", F.from_json(line, LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    keep = [c for c in lines.columns if c != line]
    return parsed.where("p._corrupt is null").select(*keep, "p.*").drop("_corrupt"), parsed.where("p._corrupt is not null").select(*keep, F.substring(line, 1, 2048).alias("detail"))


def content_counts(blocks: Column, kinds: tuple[str, ...]) -> dict[str, Column]:
    """How many blocks of each kind; null where there is no array."""

    def count(kind: str) -> Column:
        return F.when(blocks.isNotNull(), F.size(F.filter(blocks, lambda b: b["type"] == kind)))

    return {f"{k}_blocks": count(k) for k in kinds}


def calls(rows: DataFrame) -> DataFrame:
    """One row per tool_use block of assistant lines, joined to its result's outcome by id."""
    blocks = rows.select("sessionId", "uuid", "type", F.explode("message.content").alias("b"))
    used = blocks.where("b.type = 'tool_use'").select("sessionId", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"))
    got = blocks.where("b.type = 'tool_result'").groupBy("sessionId", F.col("b.tool_use_id").alias("call_id")).agg(F.bool_or("b.is_error").alias("failed"))
    return used.join(got, ["sessionId", "call_id"], "left")


def read_tree(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all matching files below a folder, with the file's path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select("value", F.col("_metadata.file_path").alias("path"))


def survey(lines: DataFrame) -> DataFrame:
    """Of each file: lines, bytes, first and last time, session."""
    stamp, session = F.get_json_object("value", "$.timestamp"), F.get_json_object("value", "$.sessionId")
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.min(session).alias("session"))


def file_changes(df: DataFrame, changes: str, *keep: str) -> DataFrame:
    """One row per changed file, from a JSON list of objects or a JSON map keyed by path."""
    as_list = F.from_json(changes, "array<struct<path:string,kind:string>>")
    as_map = F.from_json(changes, T.MapType(T.StringType(), T.StructType([T.StructField("kind", T.StringType())])))
    is_list = F.ltrim(F.col(changes)).startswith("[")
    rows = F.when(is_list, as_list).otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("path"), e["value"]["kind"].alias("kind"))))
    return df.select(*keep, F.explode(rows).alias("c")).select(*keep, "c.path", "c.kind")
