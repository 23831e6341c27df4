"""Sharding by rendezvous hashing over weighted shards.

Every (key, shard) pair has a draw from md5; the shard with the largest weighted draw gets the
row. A further shard can only win rows for itself, so growing from n to n+1 shards moves
about one row in n+1 and none between old shards. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .graph import cut

SLOT_BUCKETS, SLOT_ROWS = 64, 1_000_000


def _winner(lanes: list[Column], weights: list[float]) -> Column:
    """The shard with the least -ln(u)/weight; ties go to the lower number."""
    scores = [F.struct((-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0)) / F.lit(float(w))).alias("s"), F.lit(k).alias("k")) for k, (draw, w) in enumerate(zip(lanes, weights, strict=True))]
    return F.array_min(F.array(*scores))["k"]


def slot_buckets(rows: int, shards: int) -> int:
    """Buckets of a shard, a power of 2: at least 64, and so many that one has about SLOT_ROWS rows at most."""
    return max(SLOT_BUCKETS, 1 << max(0, rows // (shards * SLOT_ROWS)).bit_length())


def assign_shards(df: DataFrame, key: Column, weights: list[float], grown_weight: float = 1.0, buckets: int = SLOT_BUCKETS, spread: Column | None = None) -> DataFrame:
    """df with shard, grown_shard (with one more shard) and slot_bucket (0 to buckets - 1).

    spread: what deals the rows of one key to buckets, so that a key with very many rows isn't in one; null deals them by the key.

    A null key is the empty text. Four shards share one md5 of key and shard group. Columns of these names are replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    n = len(weights) + 1
    df = df.drop("shard", "grown_shard", "slot_bucket")
    named = df.withColumn("__key", F.coalesce(key.cast("string"), F.lit("")))
    blocks = [F.md5(F.concat_ws(":", F.col("__key"), F.lit(str(b)))) for b in range((n + 3) // 4)]
    drawn = named.select("*", *(b.alias(f"__m{k}") for k, b in enumerate(blocks)), F.md5(F.concat_ws(":", F.col("__key"), spread if spread is not None else F.lit("slot"))).alias("__slot"))
    lanes = [F.conv(F.substring(f"__m{s // 4}", 1 + 8 * (s % 4), 8), 16, 10).cast("double").alias(f"__u{s}") for s in range(n)]
    wide = drawn.select(*df.columns, *lanes, F.conv(F.substring("__slot", 1, 8), 16, 10).cast("long").alias("__slot"))
    u = [F.col(f"__u{s}") for s in range(n)]
    return wide.select(
        *df.columns, _winner(u[:-1], weights).alias("shard"), _winner(u, [*weights, grown_weight]).alias("grown_shard"), (F.col("__slot") % buckets).cast("int").alias("slot_bucket")
    )


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """A gapless position from 0 in each shard, by slot_bucket and then ``order``.

    Positions count within (shard, slot_bucket), so no task holds a whole shard; the
    offsets of the buckets (a row for each, see ``slot_buckets``) are broadcast.
    """
    sizes = rows.groupBy("shard", "slot_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "slot_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "slot_bucket").orderBy(*order)
    numbered = rows.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "slot_bucket"]).withColumn("slot", F.col("slot") + F.col("ahead")).drop("ahead")


def shard_documents(docs: DataFrame, weights: list[float], with_text: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text).

    size: UTF-8 bytes plus 16; a null text has none and the checksum 0. A null doc_id is the
    empty key. Rows with one doc_id share a shard; repeated rows get slots of their own.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), *(["text"] if with_text else [])
    )
    rows = rows.withColumn("size", F.col("bytes") + 16).drop("bytes")
    buckets = slot_buckets(docs.count(), len(weights))
    # rows of one doc_id are told apart by their texts; those of one id and text are alike, and may stand in any order
    assigned = assign_shards(rows, F.col("doc_id"), weights, buckets=buckets, spread=F.concat_ws(":", F.lit("slot"), F.col("size"), F.col("text_crc32")))
    if not with_text:
        assigned = cut(assigned)  # narrow rows, read twice: for the buckets' sizes and for the slots
    placed = with_slots(assigned, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast(T.IntegerType()), "slot", F.col("grown_shard").cast(T.IntegerType()), *(["text"] if with_text else [])
    )


def write_shards(docs: DataFrame, weights: list[float], path: str) -> None:
    """The documents as Parquet, one folder a shard, ordered by slot within its files."""
    rows = shard_documents(docs, weights, with_text=True)
    rows.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 40)


OP10_SQL = r"""
WITH lane AS (SELECT doc_id, s, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || (s // 4)::VARCHAR), 1 + 8 * (s % 4), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS score
  FROM documents, (SELECT unnest(range(41)) AS s)),
best AS (SELECT doc_id, arg_min(s, (score, s)) FILTER (s < 40) AS shard, arg_min(s, (score, s)) AS grown FROM lane GROUP BY doc_id),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, tab)
SELECT doc_id, bytes + 16 AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || ':slot:' || (bytes + 16)::VARCHAR || ':' || text_crc32::VARCHAR), 1, 8))::BIGINT % 64, doc_id) - 1 AS slot
FROM crc JOIN best USING (doc_id)
"""
