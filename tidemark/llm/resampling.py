"""Target-distribution importance resampling with a dictionary of distinct features.

Features are runs of 1 to ``most`` consecutive words. Texts are read in chunks. A chunk gives its per-document feature counts
as one packed row, and one row for each distinct string in it; those are added up over all chunks
into the dictionary, in which each distinct string is hashed once. Counts of strings are added up to buckets, buckets give gains, and
the gains go back, by string, to the chunks and their per-document counts. So a very frequent word is one row for each chunk,
not for each document, and no task holds more than one chunk or its share of the dictionary.

Documents are ranked by a range partitioning of their scores, with the partitions' sizes added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dealing import pack, unpack_one
from .graph import cut
from .text import LOWER, slices, word_spans

BUCKETS = 10_000
CHUNK = 4 << 20
#: fixed values: bytes of words are digits, letters and all that isn't ASCII (after A-Z are lower-cased)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
BROADCAST_GAINS = 1_000_000  # buckets up to which gains are broadcast, 16 bytes each

KINDS = {"chunk": pa.int64(), "feature": pa.string(), "code": pa.int32(), "n": pa.int64(), "rows": pa.int32(), "entries": pa.int32()} | dict.fromkeys(("words", "doc", "codes", "counts"), pa.binary())
CHUNKS = "chunk long, feature string, code int, n long, rows int, entries int, words binary, doc binary, codes binary, counts binary, ids array<{kind}>, salts array<long>"


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of texts into an array of distinct strings, and pointers from texts to words."""
    spaced = np.where(WORD[(low := LOWER[data])], low, np.uint8(32))
    starts, ends, ptr = word_spans(spaced, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    flat = np.ascontiguousarray(low[spaced != 32])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(flat)).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ptr, words.dictionary


def feature_counts(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words of each text, and sorted (text, code, count) of its distinct features, with the strings that codes stand for."""
    code, ptr, names = word_codes(data, offsets)
    names, n = names.to_pylist(), len(code)
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    end = np.repeat(ptr[1:], np.diff(ptr))
    strings, keys = list(names), [(text, code)]
    longer = code  # codes of the runs of k words that start at each word
    for k in range(2, most + 1):
        at = np.flatnonzero(np.arange(n) + k <= end)
        both = longer[at] * max(1, len(names)) + code[at + k - 1]  # a run's code and the next word's: no two runs share one
        seen, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        words = [names[c] for c in code[at[first]].tolist()]
        for j in range(1, k):
            words = [f"{w} {names[c]}" for w, c in zip(words, code[at[first] + j].tolist(), strict=True)]
        keys.append((text[at], inverse + len(strings)))
        strings += words
        longer = np.zeros(n, np.int64)
        longer[at] = inverse
    both = np.concatenate([t * max(1, len(strings)) + c for t, c in keys])
    seen, count = np.unique(both, return_counts=True)
    return np.diff(ptr), seen // max(1, len(strings)), seen % max(1, len(strings)), count, strings


def _chunks(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each chunk a row with its per-document counts, and a row for each of its distinct features."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        fields = {**KINDS, "ids": pa.list_(batch.schema.field("doc_id").type), "salts": pa.list_(pa.int64())}
        for a, b, data, offsets in slices(batch.column("text"), size):
            words, doc, code, count, strings = feature_counts(data, offsets, most)
            m = len(strings)
            whole = np.bincount(code, count, m).astype(np.int64) if m else np.zeros(0, np.int64)
            chunk = (part << 32) | made
            made += 1
            entries = [np.diff(doc, prepend=0).astype(np.uint32), code.astype(np.uint32), count.astype(np.uint32)]
            own = {"rows": pa.array([b - a], pa.int32()), "entries": pa.array([len(doc)], pa.int32()), "words": pa.array([pack(words.astype(np.uint32))])}
            own |= {k: pa.array([pack(x)], pa.binary()) for k, x in zip(("doc", "codes", "counts"), entries, strict=True)}
            for k, column in (("ids", "doc_id"), ("salts", "__salt")):
                own[k] = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(column).slice(a, b - a))
            told = {"feature": pa.array(strings, pa.string()), "code": pa.array(np.arange(m, dtype=np.int32)), "n": pa.array(whole)}
            for held, rows in ((own, 1), (told, m)):
                if rows:
                    columns = held | {"chunk": pa.array(np.full(rows, chunk), pa.int64())}
                    yield pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(rows, of) for k, of in fields.items()], list(fields))


def chunked(docs: DataFrame, most: int = 1, size: int = CHUNK) -> DataFrame:
    """A written table of the chunks of docs(doc_id, text): rows with ``ids`` hold a chunk's counts, rows with ``feature`` its distinct strings."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__salt"))
    return cut(docs.mapInArrow(partial(_chunks, most=most, size=size), CHUNKS.format(kind=dict(docs.dtypes)["doc_id"])))


def dictionary(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, s, t, bucket: each distinct string of two chunked tables once, with its counts in both, hashed once."""
    one = lambda chunks, s, t: chunks.where("feature is not null").select("feature", s.alias("s"), t.alias("t"))
    both = one(source, F.col("n"), F.lit(0).cast("long")).unionByName(one(target, F.lit(0).cast("long"), F.col("n")))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return cut(counted.withColumn("bucket", (F.crc32("feature") % buckets).cast("int")))


def bucket_gains(words: DataFrame, buckets: int = BUCKETS, scale: int = 1000) -> DataFrame:
    """bucket, gain: floor of scale times the log of the smoothed target rate over the source rate; at most ``buckets`` rows."""
    total = words.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    by = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    d = lambda x: x.cast("double")
    above = d(F.col("t") + 1) * d(F.lit(total["S"] + buckets))
    below = d(F.col("s") + 1) * d(F.lit(total["T"] + buckets))
    return cut(by.select("bucket", F.floor(F.lit(float(scale)) * F.log(above / below)).cast("long").alias("gain")))


def _weights(chunk: pa.Table, gains: pa.Table) -> pa.Table:
    """A chunk's documents, with the gains of its strings added up by its counts."""
    n, m = chunk.column("rows")[0].as_py(), chunk.column("entries")[0].as_py()
    doc, code, count = (unpack_one(chunk.column(c)[0].as_py(), m, np.uint32).astype(np.int64) for c in ("doc", "codes", "counts"))
    words = unpack_one(chunk.column("words")[0].as_py(), n, np.uint32).astype(np.int64)
    gain = np.zeros(gains.num_rows, np.int64)
    gain[gains.column("code").to_numpy()] = gains.column("gain").to_numpy()
    doc = np.cumsum(doc)
    weight, features = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(weight, doc, gain[code] * count)
    np.add.at(features, doc, count)
    ids = chunk.column("ids").combine_chunks().flatten()
    return pa.table({"doc_id": ids, "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight), "salt": chunk.column("salts").combine_chunks().flatten()})


def document_weights(source: DataFrame, words: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight and salt (a number of the row) of every document of a chunked table.

    words: its dictionary, gains: its buckets'. Strings meet the dictionary, which is a written table, so that a string of very many
    chunks can be split; what comes back to a chunk are its own distinct strings.
    """
    valued = words.select("feature", "bucket").join(F.broadcast(gains) if buckets <= BROADCAST_GAINS else gains, "bucket").select("feature", "gain")
    told = source.where("feature is not null").select("chunk", "feature", "code").join(cut(valued), "feature").select("chunk", "code", "gain")
    own = source.where("ids is not null").select(F.col("chunk").alias("of"), "rows", "entries", "words", "doc", "codes", "counts", "ids", "salts")
    kind = dict(source.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return own.groupBy("of").cogroup(told.groupBy("chunk")).applyInArrow(_weights, f"doc_id {kind}, n_words long, n_features long, weight long, salt long")


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) of a number u in (0, 1) that seed and doc_id (null: empty) decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], partitions: int, rank: str = "rank") -> DataFrame:
    """rows with their place from 1 in a total order: ranges of the order are numbered each, and the sizes of those before are added.

    rows: a written table. The placed rows are written too, so that a range that is lost is never dealt out in another way.
    """
    placed = rows.repartitionByRange(max(1, partitions), *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("__p"), (F.monotonically_increasing_id() % (1 << 33)).alias("__i")))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("__p", ahead.alias("__a"))), "__p").withColumn(rank, F.col("__i") + F.col("__a") + 1).drop("__p", "__i", "__a")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs(doc_id, text).

    rank: 1, 2, 3... by score (ties to the smaller doc_id, nulls last) of the floor(percent / 100) of rows with ``least_words`` words or more
    that are drawn, else null. Null and empty texts have no features and the weight 0. Rows that repeat a doc_id are ranked
    each, in any order where their scores are the same. size: bytes of a chunk. Other columns of docs are ignored; an empty table stays empty, and an empty target has the
    smoothed rates of no counts.
    """
    source = chunked(docs, most, size)
    words = dictionary(source, chunked(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), most), buckets)
    weighed = document_weights(source, words, bucket_gains(words, buckets), buckets)
    weighed = cut(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    full = weighed.where(F.col("n_words") >= least_words)
    drawn = full.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("salt").asc()]
    # a range holds about a million narrow rows, and there are no fewer than the session's partitions
    placed = ranked(full, order, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), drawn * 100 // max(1, percent) // 1_000_000))
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    placed = placed.withColumnRenamed("rank", "place").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    rest = weighed.where(F.col("n_words") < least_words)
    return placed.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH RECURSIVE own AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
counts AS MATERIALIZED (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT f, 1 AS s, 0 AS t FROM own UNION ALL SELECT f, 0, 1 FROM wanted) GROUP BY f),
tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
dict AS MATERIALIZED (SELECT f, s, counts.t, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(f), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM counts, tab),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM dict),
gains AS (SELECT b, floor(1000.0::DOUBLE * ln(((sum(dict.t) + 1)::DOUBLE * (any_value(total.s) + 10000)) / ((sum(dict.s) + 1)::DOUBLE * (any_value(total.t) + 10000))))::BIGINT AS g FROM dict, total GROUP BY b),
w AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS w FROM own JOIN dict USING (f) JOIN gains USING (b) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
  coalesce(w, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM d WHERE n_features >= 20)
SELECT d.*, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
