"""Quality: regularised quadratic discriminant analysis of document statistics.

Each text gives a few statistics of its bytes, words and lines, transformed to be roughly normal.
Class means and covariances are sums over all labelled rows; the covariances are shrunk towards the pooled one and
its diagonal. Scoring clips the statistics at four deviations. A score is the
logistic of the difference of the Mahalanobis log-densities, with cached Cholesky factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .text import LOWER, distinct, shingles, slices, span_hashes, sums, word_spans
from .toxicity import fold

THRESHOLD = 0.7
NAMES = ("word_length", "length_spread", "upper", "symbols", "digits", "other_bytes", "stops", "symbol_words", "fresh_words", "fresh_triples", "top_line", "fresh_lines", "line_words")
_KIND = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 common punctuation, 5 other ASCII symbol, 6 not ASCII
_KIND[33:127] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
_KIND[128:] = 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Variance-stabilised share of a whole, 0 of nothing."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; all 0 for an empty one."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, ptr = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    count = np.diff(ptr)
    kinds = [sums((_KIND[data] == k).astype(np.int64), offsets) for k in range(7)]
    solid = sum(kinds[1:])
    length = (ends - starts).astype(float)
    mean = sums(length, ptr) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(sums(length * length, ptr) / np.maximum(count, 1) - mean * mean, 0))
    tail = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.int8)
    head = _KIND[data[starts]] if len(starts) else np.zeros(0, np.int8)
    symbol = sums(((tail == 5) | (head == 5)).astype(np.int64), ptr)
    stop = sums((tail == 4).astype(np.int64), ptr)
    _, once = distinct(words, ptr)
    triple, tp = shingles(words, ptr, 3)
    _, triples = distinct(triple, tp)
    # lines are spans between line ends, hashed like words
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    line = low != 10
    begin, end = line.copy(), line.copy()
    begin[1:] &= ~line[:-1] | first[1 : len(low)]
    end[:-1] &= ~line[1:] | first[1 : len(low)]
    ls, le = np.flatnonzero(begin), np.flatnonzero(end) + 1
    lp = np.searchsorted(ls, offsets)
    lines = np.diff(lp)
    hashed = span_hashes(low, ls, le)
    uniq, up = distinct(hashed, lp)
    longest = np.zeros(n, np.int64)
    some = np.flatnonzero(lines)
    if len(some):
        longest[some] = np.maximum.reduceat(le - ls, lp[some])
    fresh = np.diff(once) / np.maximum(count, 1) ** 0.85  # distinct words grow slower than words
    return np.where(
        (count > 0)[:, None],
        np.stack(
            [np.log1p(mean), np.log1p(spread), _share(kinds[1], kinds[1] + kinds[2]), _share(kinds[5], solid), _share(kinds[3], solid), _share(kinds[6], solid), _share(stop, count),
             _share(symbol, count), np.log1p(fresh), _share(np.diff(triples), np.diff(tp)), _share(longest, sums(line.astype(np.int64), offsets)), _share(np.diff(up), lines), np.log1p(count / np.maximum(lines, 1))], 1),
        0.0,
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: array<double> and empty for every row of docs; null texts count as empty."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                x = statistics(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), flat], ["doc_id", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _added(rows: DataFrame, centre: dict[int, np.ndarray] | None = None) -> dict[int, tuple[float, np.ndarray]]:
    """Count of each label, and its statistics' sum or, given its centre, its sum of outer products about that; one small row a task and label is added up."""
    d = len(NAMES)

    def run(batches):
        held = {k: [0, np.zeros(d if centre is None else (d, d))] for k in (0, 1)}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
            y = batch.column("label").to_numpy()
            for k, h in held.items():
                z = x[y == k]
                h[0] += len(z)
                h[1] += z.sum(0) if centre is None else (z - centre[k]).T @ (z - centre[k])
        for k, (n, s) in held.items():
            values = np.concatenate([[n], s.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["label", "i", "v"])

    added = rows.mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).orderBy("label", "i").collect()
    out = {}
    for k in (0, 1):
        v = np.array([r["v"] for r in added if r["label"] == k])
        if len(v) and v[0] > 1:
            out[k] = v[0], v[1:]
    return out


def fit_quality(stats: DataFrame, labels: DataFrame, pooled: float = 0.2, diagonal: float = 0.05) -> dict | None:
    """The discriminant from stats(doc_id, x) and labels(doc_id, label 0/1); None if a class has under two rows.

    An id counts once, however often docs or labels repeat it: with its least statistics, and its larger label. Means come first,
    and the moments are about them, so a statistic that is the same in all labelled rows has no variance but for rounding;
    it gets no weight.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    once = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r"))
    once = cut(once.select("r.x", "r.label"))  # read twice
    sums_ = _added(once)
    if len(sums_) < 2:
        return None
    count = {k: n for k, (n, _) in sums_.items()}
    own = {k: s / n for k, (n, s) in sums_.items()}
    outer = {k: q.reshape(len(NAMES), -1) for k, (_, q) in _added(once, own).items()}
    total = sum(count.values())
    mean = sum(count[k] * own[k] for k in own) / total
    variance = np.diag(sum(outer[k] + count[k] * np.outer(own[k] - mean, own[k] - mean) for k in own)) / total
    varies = variance > 1e-12 * (1 + mean * mean)
    scale = np.sqrt(np.maximum(variance, 1e-9))
    means = {k: np.where(varies, (own[k] - mean) / scale, 0.0) for k in own}
    covs = {k: np.where(np.outer(varies, varies), outer[k] / count[k] / np.outer(scale, scale), 0.0) for k in own}
    common = sum(count[k] * covs[k] for k in covs) / total
    factors, logs = {}, {}
    for k in covs:
        c = (1 - pooled) * covs[k] + pooled * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(common) + 0.05)
        factor = np.linalg.cholesky(c)
        factors[k] = np.linalg.inv(factor)  # whitening: |factors (x - mean)|^2 is the Mahalanobis distance
        logs[k] = np.log(count[k] / total) - np.log(np.diag(factor)).sum()
    return {"mean": mean, "scale": scale, "varies": varies, "means": means, "factors": factors, "logs": logs}


def score_quality(stats: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: good); 0.5 for all where no model could be fitted."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            if model is None:
                margin = np.zeros(len(x))
            else:
                z = np.where(model["varies"], np.clip((x - model["mean"]) / model["scale"], -4, 4), 0.0)
                dense = {k: model["logs"][k] - 0.5 * (((z - model["means"][k]) @ model["factors"][k].T) ** 2).sum(1) for k in (0, 1)}
                margin = dense[1] - dense[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], ["doc_id", "score"])

    kind = dict(stats.dtypes)["doc_id"]
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs. labels(doc_id, label): the rows to learn from."""
    stats = cut(document_statistics(docs))
    return score_quality(stats, fit_quality(stats, labels))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
