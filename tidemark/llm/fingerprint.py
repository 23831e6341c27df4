"""Threshold-scaled document fingerprints.

A fingerprint keeps every word-shingle hash below a fixed fraction of the hash space, and nothing else, so its
size follows the document's, two fingerprints of very unequal documents still estimate containment, and
the union of fingerprints is the fingerprint of the union. It is written as the sorted hashes, 12 hex digits
each (the upper 48 bits). A text with words but no hash below the fraction has, in place of an empty one, a mark ``~`` and
its least hash: it tells small texts apart, and merging leaves it out as soon as either side has a kept hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import arrow_bytes, distinct, shingles, slices, word_hashes

U = np.uint64
WORDS, SCALE, WIDTH = 5, 4, 12


MARK = U(1) << U(63)  # in front of the least hash of a text that keeps none


def sketch(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit hashes of each text's fingerprint, with pointers; a marked one where a text with words keeps none."""
    h, ptr = shingles(*word_hashes(data, offsets), words)
    n = np.diff(ptr)
    h = h >> U(16)
    keep = h < U((1 << 48) // scale)
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    bare = np.flatnonzero((n > 0) & (kept[ptr[1:]] == kept[ptr[:-1]]))
    for row in bare.tolist():
        at = ptr[row] + int(np.argmin(h[ptr[row] : ptr[row + 1]]))
        h[at] |= MARK
        keep[at] = True
    np.cumsum(keep, out=kept[1:])
    return distinct(h[keep], kept[ptr])


def hex_strings(values: np.ndarray, ptr: np.ndarray) -> list[str]:
    text = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()
    out = [text[WIDTH * a : WIDTH * b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
    marked = np.flatnonzero(values >= MARK)
    for row in (np.searchsorted(ptr, marked, "right") - 1).tolist():
        out[row] = "~" + out[row]
    return out


def likeness(a: np.ndarray, ap: np.ndarray, b: np.ndarray, bp: np.ndarray) -> np.ndarray:
    """Jaccard estimate of row i of a against row i of b; two empty ones are alike (1).

    Two marked ones are alike if they are the same (the odds of that are the Jaccard similarity), a marked and a kept one aren't.
    """
    n = len(ap) - 1
    na, nb = np.diff(ap), np.diff(bp)
    a, b = (np.where(x >= MARK, x ^ MARK, x) for x in (a, b))  # a marked hash is above the fraction, a kept one below
    common = np.zeros(n, np.int64)
    for i in range(0, n, 60_000):  # a row number of 16 bits goes in front of each hash
        j = min(n, i + 60_000)
        ka = (np.repeat(np.arange(j - i), na[i:j]).astype(U) << U(48)) | a[ap[i] : ap[j]]
        kb = (np.repeat(np.arange(j - i), nb[i:j]).astype(U) << U(48)) | b[bp[i] : bp[j]]
        both = np.intersect1d(ka, kb, assume_unique=True) >> U(48)
        common[i:j] = np.bincount(both.astype(np.int64), minlength=j - i)
    union = na + nb - common
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def hashes(fingerprint: Column) -> Column:
    """A fingerprint's kept hashes as an array; a marked one isn't kept."""
    return F.when(fingerprint.startswith("~"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(fingerprint, F.lit("(.{12})"), F.lit(1)))


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of ``part``'s shingles that ``whole`` has; null if ``part`` keeps no hash."""
    return F.try_divide(F.size(F.array_intersect(hashes(part), hashes(whole))), F.size(hashes(part)))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' shingles together."""
    kept = F.array_join(F.array_sort(F.array_union(hashes(a), hashes(b))), "")
    bare = F.least(F.when(a != "", a), F.when(b != "", b))
    return F.when(kept != "", kept).otherwise(F.coalesce(bare, F.lit("")))


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """df with ``fingerprint``; null texts count as empty, whose fingerprint is the empty text."""
    df = df.drop("fingerprint") if text != "fingerprint" else df

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(text)):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(hex_strings(*sketch(data, offsets, words, scale)), pa.string())], [*batch.schema.names, "fingerprint"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fingerprint", T.StringType())]))


def _rows(ids: pa.Array, text: pa.Array, words: int, scale: int) -> pa.RecordBatch:
    """Results of all rows but the last, which is only the next one of the row before it."""
    data, off = arrow_bytes(text)
    n = len(off) - 2
    first = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=chars[1:])
    at = np.append(np.flatnonzero(first), len(data))
    count = np.diff(chars[off])
    half = count // 2
    edited, shas = [], []
    raw = data.tobytes()
    for i in range(n):
        stop = at[chars[off[i]] + count[i] - half[i]] if half[i] else off[i + 1]
        take = min(half[i], count[i + 1])
        end = at[chars[off[i + 1]] + take] if take < count[i + 1] else off[i + 2]
        made = raw[off[i] : stop] + raw[off[i + 1] : end]
        edited.append(made)
        shas.append(hashlib.sha256(made).hexdigest())
    own, op = sketch(data, off, words, scale)
    eoff = np.concatenate([[0], np.cumsum([len(x) for x in edited])]).astype(np.int64)
    new, np_ = sketch(np.frombuffer(b"".join(edited), np.uint8), eoff, words, scale)
    return pa.RecordBatch.from_arrays(
        [ids.slice(0, n), pa.array(count[:n]), pa.array(shas, pa.string()), pa.array(hex_strings(own, op)[:n], pa.string()), pa.array(hex_strings(new, np_), pa.string()),
         pa.array(likeness(own[: op[n]], op[: n + 1], new, np_)), pa.array(likeness(own[: op[n]], op[: n + 1], own[op[1] :], op[1:] - op[1]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PIECE = 1 << 20
RANGE_BYTES, MOST_RANGES = 1 << 28, 10_000


def neighbour_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and the next document.

    The edited text has its last floor(n_chars/2) code points replaced by as many first ones of the
    next document, in descending doc_id (ties by text, null ids last; after the last comes the first).
    Rows are dealt to ranges of doc_id whose ends are ids of the data; the row at an end is also sent to
    the range that follows, so each range is read once, in order, and texts are shuffled once. ranges: by default one
    for RANGE_BYTES of text, MOST_RANGES at most; a range is streamed in pieces of PIECE bytes, so it may be larger. Rows of
    one repeated doc_id, and those without any, are a range of their own, which is sorted on disk if need be.
    Other columns of docs are ignored; an empty table has no rows, and a single row is its own next document.
    """
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = int(min(MOST_RANGES, max(64, size // RANGE_BYTES)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)).alias("b"), F.max("doc_id").alias("m")).first()
    ends = sorted({*(bounds["b"] or []), bounds["m"]}) if bounds["m"] is not None else []
    held = F.lit(ends).cast("array<bigint>") if ends else F.expr("cast(array() as array<bigint>)")
    # how many ends lie below: among every step-th one, then among those between
    step = max(1, int(len(ends) ** 0.5))
    above = F.size(F.filter(F.lit(ends[step - 1 :: step]).cast("array<bigint>"), lambda e: e < F.col("doc_id"))) * step if ends else F.lit(0)
    place = F.coalesce(above + F.size(F.filter(F.slice(held, above + 1, F.lit(step)), lambda e: e < F.col("doc_id"))), F.lit(0))
    follows = F.when(F.col("doc_id") == F.lit(ends[-1] if ends else 0), F.lit(0)).otherwise(F.col("place") + 1)
    copies = F.when(F.array_contains(held, F.col("doc_id")), F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("tail")), F.struct(follows.alias("place"), F.lit(1).alias("tail"))))
    dealt = docs.withColumn("place", place).select("doc_id", "text", F.explode(F.coalesce(copies, F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("tail"))))).alias("c"))
    dealt = dealt.select("doc_id", "text", "c.place", "c.tail").repartition("place")
    ordered = dealt.sortWithinPartitions("place", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        kept: pa.RecordBatch | None = None  # rows of the range whose next row hasn't come
        first = None
        for batch in batches:
            whole = pa.Table.from_batches([kept, batch]) if kept is not None else pa.Table.from_batches([batch])
            whole = whole.combine_chunks()
            place, tail = whole.column("place").to_numpy(), whole.column("tail").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            kept = None
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if first is None or first[0] != place[a]:
                    first = (place[a], whole.slice(a, 1))
                body = a + int((tail[a:b] == 0).sum())
                stop = min(body + 1, b)  # the body and the first row of the tail
                yield from pieces(whole.slice(a, stop - a))
                if b == len(place):
                    if body == b:
                        kept = whole.slice(b - 1, 1).combine_chunks().to_batches()[0]
                    elif body + 1 <= b:
                        kept = None
                elif body == b:  # only where all ids are null: the first row follows the last
                    yield from pieces(pa.concat_tables([whole.slice(b - 1, 1), first[1]]))
        if kept is not None:
            yield from pieces(pa.concat_tables([pa.Table.from_batches([kept]), first[1]]))

    def pieces(rows: pa.Table):
        if len(rows) < 2:
            return
        rows = rows.combine_chunks()
        ids, text = rows.column("doc_id").chunk(0), rows.column("text").chunk(0)
        _, off = arrow_bytes(text)
        a = 0
        while a < len(rows) - 1:
            b = min(len(rows) - 1, max(a + 1, int(np.searchsorted(off, off[a] + PIECE, "right")) - 1))
            yield _rows(ids.slice(a, b + 1 - a), text.slice(a, b + 1 - a), words, scale)
            a = b

    return ordered.mapInArrow(run, RESULT)


def op3_scaled_fingerprint(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
