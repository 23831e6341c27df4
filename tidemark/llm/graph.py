"""Distributed connected components and the shared-folder checkpoints that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000  # of at most about 50 bytes


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A written copy of df in the folder of spark.checkpoint.dir; only where that is unset on a local master one is made.

    A table, not checkpoint(): that keeps the plan's estimated size, which joins multiply, so that in loops it gets
    thousands of digits; a table has its true size.
    """
    at = f"{_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def beside(rows: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined to a materialised side (see ``cut``) of narrow rows.

    Up to ``limit`` rows the side is broadcast. Beyond, both are shuffled; as the side is no aggregate of the same
    stage, adaptive execution can split a key that very many rows have.
    """
    return rows.join(F.broadcast(side) if side.count() <= limit else side, on, how)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each keeps at most as many edges as it was
    given. Every step is a grouped minimum, written out, and a join with it, so a node with very many
    neighbours is added up before the shuffle and its join is a broadcast or can be split. Self loops are left out;
    no edges give no rows.
    """
    now = cut(edges.where("u != v").select("u", "v").distinct())
    was = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = beside(both, cut(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(down, cut(low), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u != v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        seen = (seen["n"], seen["s"])
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError("components: no convergence")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
