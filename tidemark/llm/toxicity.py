"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features say whether a hashed n-gram of the code points (A-Z lower-cased, white space all one) occurs. Each is scaled by the
log ratio of its smoothed rates in toxic and other texts; a logistic regression with an L2 penalty is
fitted over the scaled features. Fitting reads at most ``sample`` labelled rows of each class, those
with the smallest hash of doc_id; class shares are counted over all labelled rows. Scoring reads whole texts.
Without labelled rows of both classes, or without any n-gram that tells them apart, there is no model, and every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LOWER, SMALL, SPACE, mix64, slices, tidied

U = np.uint64
BITS = 20
GRAM = 5
SAMPLE = 3000
THRESHOLD = 0.5
LANES = mix64(np.arange(1, GRAM + 1, dtype=U)) | U(1)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts, each as its UTF-8 bytes in one number, with pointers."""
    low = np.where(SPACE[data], np.uint8(32), LOWER[data])
    lead = (low & 0xC0) != 0x80
    if lead.all():
        return low.astype(U), offsets
    at = np.flatnonzero(lead)
    out = low[at].astype(U)
    width = np.diff(np.append(at, len(low)))
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        out[more] = (out[more] << U(8)) | low[at[more] + k].astype(U)
    count = np.zeros(len(low) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    return out, count[offsets]


def grams(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-gram that starts at each character, whether it ends within its text, and pointers from texts to characters."""
    points, ptr = code_points(data, offsets)
    n = len(points)
    packed = np.zeros(n, U)
    for k in range(min(gram, n)):
        packed[: n - k] += (points[k:] + U(1)) * LANES[k]
    end = np.repeat(ptr[1:], np.diff(ptr))
    return (mix64(packed) >> U(64 - BITS)).astype(np.int32), np.arange(n) + gram <= end, ptr


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct n-gram, by text; wanted: features to keep."""
    feature, whole, ptr = grams(data, offsets)
    keep = whole if wanted is None else whole & wanted[feature]
    at = np.flatnonzero(keep)
    text = np.searchsorted(ptr, at, "right") - 1
    key = np.unique((text.astype(np.int64) << BITS) | feature[at])
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)


def _fit(table: pa.Table, share: float) -> pa.Table:
    """Weights of the features and the intercept (feature -1) from a bounded table of texts and labels.

    share: of toxic rows among all labelled ones.
    """
    label = table.column("label").to_numpy().astype(float)
    order = np.argsort(table.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
    table, label = table.take(pa.array(order)), label[order]
    found, p, q = [], np.zeros(1 << BITS), np.zeros(1 << BITS)  # counts are whole numbers, which add up exactly in any order
    for a, _, data, offsets in slices(table.column("text").combine_chunks(), SMALL):
        r, c = present(data, offsets)
        r = (r + a).astype(np.int32)
        p += np.bincount(c, label[r], 1 << BITS)
        q += np.bincount(c, 1 - label[r], 1 << BITS)
        found.append((r, c))
    n1, n0 = label.sum(), (1 - label).sum()
    nothing = pa.table({"feature": pa.array([], pa.int32()), "weight": pa.array([], pa.float64())})
    if not n1 or not n0:
        return nothing
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    rate = (p + q + 1) / (n1 + n0 + 2)
    z = (p / n1 - q / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    use = (p + q >= 3) & (np.abs(z) > 3.5) & (np.abs(ratio) > 0.5)
    if not use.any():
        return nothing
    number = np.cumsum(use) - 1
    # of all n-grams only those that are used are held together
    found = [(r[use[c]].astype(np.int64), number[c[use[c]]]) for r, c in found]
    row, col = (np.concatenate(x) for x in zip(*found, strict=True))
    r = ratio[use]
    x = r[col]
    w, b = np.zeros(len(r)), 0.0
    # gradient descent with momentum; the step is bounded by the largest row norm
    norm = np.bincount(row, x * x, len(label))
    step = 4.0 / (np.percentile(norm, 95) + 1) if len(norm) else 1.0
    vw, vb = np.zeros(len(r)), 0.0
    for _ in range(150):
        margin = np.bincount(row, x * w[col], len(label)) + b
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(label)
        gw = np.bincount(col, x * g[row], len(r)) + 1e-4 * w
        vw, vb = 0.9 * vw - step * gw, 0.9 * vb - g.sum()
        w, b = w + vw, b + vb
    # calibration: a logistic of the margin, with the classes weighed by their shares in all labels
    margin = np.bincount(row, x * w[col], len(label)) + b
    weight = np.where(label == 1, share / n1, (1 - share) / n0) * len(label)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([margin, np.ones_like(margin)], 1)
    turn = np.array([1.0, np.log(share / (1 - share)) - np.log(n1 / n0)])
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(design @ turn, -30, 30)))
        slope = design.T @ (weight * (target - guess)) - 1e-3 * (turn - [1, 0])
        bend = (design * (weight * guess * (1 - guess))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        turn = turn + move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return pa.table({"feature": pa.array(np.append(np.flatnonzero(use), -1), pa.int32()), "weight": np.append(w * r * turn[0], b * turn[0] + turn[1])})


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of docs(doc_id, text), or None if there is none.

    labels(doc_id, label 0/1) choose the rows to learn from; null labels or ids are left out, and an id that is
    labelled both ways counts as toxic.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # rows that repeat an id don't add to the sample
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = chosen.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: tidied(_fit(t, share)), "feature int, weight double").collect()
    if not rows:
        return None
    bias = next(r["weight"] for r in rows if r["feature"] < 0)
    rows = [r for r in rows if r["feature"] >= 0]
    return {"feature": np.array([r["feature"] for r in rows], np.int32), "weight": np.array([r["weight"] for r in rows]), "bias": float(bias)}


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic), 0 for all without a model.

    Null texts count as empty and get the intercept's score. A column score of docs is replaced; repeated rows
    are scored each; an empty table stays empty.
    """
    if model is None:
        return docs.drop("score").withColumn("score", F.lit(0.0))
    weight = np.zeros(1 << BITS, np.float32)
    weight[model["feature"]] = model["weight"]
    bias = model["bias"]
    held = docs.sparkSession.sparkContext.broadcast(weight)  # 4 MB, fixed
    docs = docs.drop("score")

    def run(batches):
        weight = held.value
        wanted = weight != 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), SMALL):
                row, col = present(data, offsets, wanted)
                margin = np.bincount(row, weight[col], b - a) + bias
                score = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score)], [*batch.schema.names, "score"])

    return docs.mapInArrow(lambda it: tidied(run(it)), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity_scores(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """docs with score, by a model of the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs, model)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity_scores(spark, sf_dir, docs)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
