"""Deleted interpolation: a trigram language model mixed by context-frequency buckets.

P(w | u v) = l3[b] c(u, v, w)/c(u, v) + l2[b] c(v, w)/c(v) + l1[b] c(w)/N + l0[b]/(V+1), where b is the bucket of
c(u, v), or of c(v) where u v was never seen. The weights of each bucket are learned by expectation-maximisation on
held-out counts: one fold of the training documents is kept apart from the counts then, and joins them for scoring.

No table of n-grams is ever whole in one place. Documents are packed in chunks; each chunk sends its distinct n-gram
hashes with their counts, dealt by hash range; a range adds up the counts of all chunks and answers each chunk
in its own order; chunk and answers meet again for scoring. A frequent n-gram is one entry a chunk. A chunk
is dealt to 2^FAN_BITS ranges at most; beyond, the cells of a range are merged in packs, which ask in their turn, so a
frequent n-gram is one entry a pack and the number of cells grows with the corpus, not with its square.

Words are hashed to 64 bits; of pairs and triples so many bits are kept that two of them share a hash with odds of about
one in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import cells, levels_of, pack, unpack, unpack_one
from .graph import cut
from .text import mix64, slices, sums, word_hashes

U = np.uint64
END, BEGIN = U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47)
CHUNK_BYTES = 5 << 20
RANGE_IDS = 1_000_000
BUCKETS = 24
GRID = 2  # steps an octave of the held-out histogram
FAN_BITS = 12
PACK_CELLS = 1024
SPARE_BITS = 20
BYTES_A_GRAM = 3.4  # text bytes for each distinct n-gram of a chunk


def _bytes(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunks(docs: DataFrame) -> DataFrame:
    """g, tune, n_bytes, blob: documents of docs(doc_id, text, fold) in packs of about CHUNK_BYTES.

    tune: whether the pack is of the fold that the weights are learned from; the lowest bit of g says it, too.
    """

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held = {True: ([], 0), False: ([], 0)}

        def packed(tune: bool):
            nonlocal made
            rows, size = held[tune]
            held[tune] = ([], 0)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(((part << 24) | made) << 1) | tune]), pa.array([tune]), pa.array([size]), pa.array([_bytes(pa.concat_tables(rows).combine_chunks())], pa.binary())], ["g", "tune", "n_bytes", "blob"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.set_column(1, "text", table.column("text").cast(pa.large_string()))
            fold = table.column("fold").to_numpy()
            for tune in (False, True):
                mine = table.filter(pa.array((fold == 6) == tune))
                for a, b, data, _ in slices(mine.column("text").combine_chunks(), CHUNK_BYTES // 4):
                    rows, size = held[tune]
                    rows.append(mine.slice(a, b - a))
                    held[tune] = rows, size + len(data) + 8 * (b - a)
                    if held[tune][1] >= CHUNK_BYTES:
                        yield packed(tune)
        for tune in (False, True):
            if held[tune][0]:
                yield packed(tune)

    return docs.mapInArrow(run, "g long, tune boolean, n_bytes long, blob binary")


def _kept(h: np.ndarray, width: int) -> np.ndarray:
    return h >> U(64 - width) << U(64 - width)


class _Chunk:
    """The tokens of a chunk's documents: words and one end each; the distinct n-grams that end at them, and which is which."""

    def __init__(self, blob: bytes, width: int) -> None:
        self.rows = _rows(blob)
        self.fold = self.rows.column("fold").to_numpy()
        parts, sizes = [], []
        for _, _, data, offsets in slices(self.rows.column("text").combine_chunks()):
            w, ptr = word_hashes(data, offsets)
            out = np.zeros(len(w) + len(ptr) - 1, U)
            ends = ptr[1:] + np.arange(len(ptr) - 1)
            out[:] = END
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep] = w
            parts.append(out)
            sizes.append(np.diff(ptr) + 1)
        self.token = np.concatenate(parts) if parts else np.zeros(0, U)
        self.ptr = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.ptr[:-1]] = BEGIN
        self.first = self.ptr[:-1]
        pair = mix64(before * U(0xD6E8FEB86659FD93) + mix64(self.token))
        self.ids, self.at = {}, {}
        self._number(1, self.token)
        self._number(2, _kept(pair, width))
        before[1:] = pair[:-1]  # now the pair in front
        before[self.first] = BEGIN
        pair = mix64(before * U(0xA0761D6478BD642F) + mix64(self.token) + U(1))
        del before, self.token
        self._number(3, _kept(pair, width))
        fold = np.repeat(self.fold, np.diff(self.ptr))
        self.core, self.tune = (fold != 2) & (fold != 6), fold == 6

    def _number(self, kind: int, h: np.ndarray) -> None:
        """The distinct n-grams of a kind, and which one ends at each token."""
        self.ids[kind], at = np.unique(h, return_inverse=True)
        self.at[kind] = at.astype(np.int32)

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, at = self.ids[kind], self.at[kind]
        return ids, np.bincount(at, self.core, len(ids)).astype(U), np.bincount(at, self.tune, len(ids)).astype(U)


def _requests(batches, bits: int, width: int):
    for batch in batches:
        for g, blob in zip(batch.column("g").to_pylist(), batch.column("blob"), strict=True):
            c = _Chunk(blob.as_py(), width)
            for kind in (1, 2, 3):
                ids, core, tune = c.counts(kind)
                yield from cells(ids, g, bits, {"core": core, "tune": tune}, width if kind > 1 else 64, kind=kind)


CELL = "p int, g long, n int, value binary, core binary, tune binary, kind int"
ANSWER = "g long, kind int, p int, n int, core binary, every binary, totals array<long>"


def _summed(table: pa.Table, kind: int) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of one kind, their lengths, distinct values, where each entry's is, and the values' counts."""
    mine = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    values, at = np.unique(unpack(mine, "value"), return_inverse=True)
    core, tune = (np.bincount(at, unpack(mine, k).astype(float), len(values)).astype(U) for k in ("core", "tune"))
    return mine, mine.column("n").to_pylist(), values, at, core, tune


def _replies(mine: pa.Table, n: list[int], at: np.ndarray, core: np.ndarray, every: np.ndarray, kind: int, out: dict) -> None:
    """Adds each cell's answer; what the fold of the weights leaves is told to its own chunks only."""
    edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    for g, p, a, b in zip(mine.column("g").to_pylist(), mine.column("p").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        row = g, kind, p, b - a, pack(core[at[a:b]]) if g & 1 else b"", pack(every[at[a:b]]), []
        for k, v in zip(out, row, strict=True):
            out[k].append(v)


def _table(out: dict) -> pa.Table:
    kinds = {"g": pa.int64(), "kind": pa.int32(), "p": pa.int32(), "n": pa.int32(), "core": pa.binary(), "every": pa.binary(), "totals": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _answers(table: pa.Table) -> pa.Table:
    """One range's counts, added over all chunks; a row with g = -1 has its totals of single words."""
    out = {k: [] for k in ("g", "kind", "p", "n", "core", "every", "totals")}
    for kind in (1, 2, 3):
        mine, n, _, at, core, tune = _summed(table, kind)
        if kind == 1:
            every = core + tune
            totals = [int(core.sum()), int((core > 0).sum()), int(every.sum()), int((every > 0).sum())]
            for k, v in zip(out, (-1, 0, 0, 0, b"", b"", totals), strict=True):
                out[k].append(v)
        if n:
            _replies(mine, n, at, core, core + tune, kind, out)
    return _table(out)


def ask(asked: DataFrame, levels: list[int], chunks: int, width: int, skip: int = 0) -> DataFrame:
    """ANSWER rows for cells that are dealt by levels[0] bits behind the first ``skip`` ones.

    If more levels follow, the cells of a range are merged in packs, the packs' cells ask, and each pack answers its own.
    """
    if len(levels) == 1:
        return asked.groupBy("p").applyInArrow(lambda t: _answers(t), ANSWER)
    skip += levels[0]
    packs = -(-chunks // PACK_CELLS) + 1
    # the lowest bit stays: a pack with cells of the fold of the weights needs both counts
    asked = cut(asked.withColumn("pack", (F.col("p").cast("long") * packs + F.pmod(F.xxhash64("g"), F.lit(packs))) * 2 + 1))

    def merge(t: pa.Table) -> pa.Table:
        made = []
        for kind in (1, 2, 3):
            _, n, values, _, core, tune = _summed(t, kind)
            w = width if kind > 1 else 64
            if n:
                made += cells(values << U(64 - w), t.column("pack")[0].as_py(), levels[1], {"core": core, "tune": tune}, w, t.column("p")[0].as_py(), skip, kind=kind)
        return pa.Table.from_batches(made)

    def split(t: pa.Table, replies: pa.Table) -> pa.Table:
        out = {k: [] for k in ("g", "kind", "p", "n", "core", "every", "totals")}
        for kind in (1, 2, 3):
            mine, n, _, at, _, _ = _summed(t, kind)
            if n:
                found = _in_order(replies, kind)
                _replies(mine, n, at, *found, kind, out)
        return _table(out)

    answers = cut(ask(asked.groupBy("pack").applyInArrow(lambda t: merge(t), CELL), levels[1:], packs << levels[0], width, skip))
    mine = answers.where("g >= 0").withColumn("pack", F.col("g"))
    told = asked.groupBy("pack").cogroup(mine.groupBy("pack")).applyInArrow(lambda a, b: split(a, b), ANSWER)
    return told.unionByName(answers.where("g < 0"))


def _in_order(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The core and whole counts of a kind's n-grams, by range; core is empty if it wasn't told."""
    p = replies.column("p").to_numpy()
    rows = np.flatnonzero(replies.column("kind").to_numpy() == kind)
    rows = rows[np.argsort(p[rows], kind="stable")].tolist()
    parts = {"core": [np.zeros(0, U)], "every": [np.zeros(0, U)]}
    for r in rows:
        for name, held in parts.items():
            data = replies.column(name)[r].as_py()
            held.append(unpack_one(data, replies.column("n")[r].as_py(), U) if data else np.zeros(0, U))
    return np.concatenate(parts["core"]), np.concatenate(parts["every"])


def _counted(chunk: _Chunk, answers: pa.Table, tuning: bool) -> list[np.ndarray]:
    """c(w), c(v), c(v, w), c(u, v) and c(u, v, w) of each token. The count of BEGIN is that of the ends: one a document."""
    found = {k: _in_order(answers, k)[0 if tuning else 1].astype(np.int64) for k in (1, 2, 3)}
    if any(len(found[k]) != len(chunk.ids[k]) for k in found):
        raise ValueError("answers don't fit their chunk")
    word, pair, triple = (found[k][chunk.at[k]] for k in (1, 2, 3))
    out = [word]
    documents = found[1][np.searchsorted(chunk.ids[1], END)] if len(word) else 0
    for counts, whole in ((word, pair), (pair, triple)):
        context = np.empty_like(counts)
        context[1:] = counts[:-1]
        context[chunk.first] = documents
        out += [context, whole]
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2), bounded by BUCKETS - 1."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def buckets(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The bucket of the two-word context, or BUCKETS and that of the one-word context if the former is unseen."""
    return np.where(two > 0, bucket(two), BUCKETS + bucket(one))


def _level(x: np.ndarray) -> np.ndarray:
    """Probabilities on a grid of GRID steps an octave; -1 for 0."""
    return np.where(x > 0, np.round(-np.log2(np.maximum(x, 1e-300)) * GRID), -1).astype(np.int64)


def learn_weights(cells_: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """2 BUCKETS x 4 mixture weights (triple, pair, word, uniform) by EM over held-out cells (bucket, their levels, count)."""
    b, n = cells_[:, 0], cells_[:, -1]
    parts = np.stack([*(np.where(i >= 0, 2.0 ** (-i / GRID), 0) for i in cells_[:, 1:4].T), np.full(len(b), uniform)], 1)
    seen = np.ones((2 * BUCKETS, 4))
    seen[BUCKETS:, 0] = 0  # an unseen context of two words has no triples, one of one word no pairs
    seen[[0, BUCKETS], :2] = 0
    weights = seen / seen.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = weights[b] * parts
        share = joint / joint.sum(1, keepdims=True) * n[:, None]
        total = np.stack([np.bincount(b, share[:, k], 2 * BUCKETS) for k in range(4)], 1)
        overall = total.sum(0) / max(total.sum(), 1)
        weights = (total + overall + 1e-6) * seen  # one pseudo token for rare buckets
        weights /= weights.sum(1, keepdims=True)
    return weights


def _met(chunked: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return chunked.select("g", "blob").groupBy("g").cogroup(answers.where("g >= 0").groupBy("g")).applyInArrow(lambda a, b: run(a, b), schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text).

    Training rows are those whose crc32(doc_id as text) mod 7 is not 2; among them 6 is the fold for the weights.
    Null texts count as empty: one end token. A null id counts as the empty text. Repeated rows are
    counted and scored each. Without training rows all counts are 0.
    """
    kind = dict(docs.dtypes)["doc_id"]
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7).cast("int")
    chunked = cut(chunks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.alias("fold"))))
    size = chunked.agg(F.sum("n_bytes")).first()[0] or 0
    grams = max(1, size / BYTES_A_GRAM)
    levels = levels_of(max(0, int(np.ceil(np.log2(grams / RANGE_IDS)))), FAN_BITS)
    width = min(64, SPARE_BITS + max(16, int(np.ceil(np.log2(grams)))))
    asked = chunked.select("g", "blob").mapInArrow(lambda it: _requests(it, levels[0], width), CELL)
    answers = cut(ask(asked, levels, int(size // CHUNK_BYTES) + 1, width))
    totals = [r["t"] for r in answers.where("g < 0").select(F.col("totals").alias("t")).agg(*(F.sum(F.element_at("t", k)).alias(f"t{k}") for k in range(1, 5))).select(F.array("t1", "t2", "t3", "t4").alias("t")).collect()][0]
    n_core, v_core, n_all, v_all = (int(x or 0) for x in totals)

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({k: pa.array([], pa.int64()) for k in ("key", "n")})
        chunk = _Chunk(left.column("blob")[0].as_py(), width)
        word, one, pair, two, triple = _counted(chunk, right, tuning=True)
        key = buckets(one, two)
        for x in (triple / np.maximum(two, 1), pair / np.maximum(one, 1), word / max(n_core, 1)):
            key = key * 256 + _level(x) + 1
        key, n = np.unique(key, return_counts=True)
        return pa.table({"key": key, "n": n})

    # at most 2 BUCKETS x levels^3 cells, whatever the corpus
    tuning = chunked.where("tune")
    wanted = answers.where("g % 2 = 1")
    rows = _met(tuning, wanted, held_out, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    key, n = (rows.column(k).to_numpy().astype(np.int64) for k in ("key", "n"))
    weights = learn_weights(np.stack([key >> 24, *((key >> k & 255) - 1 for k in (16, 8, 0)), n], 1), 1 / (v_core + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left.column("blob")[0].as_py(), width)
        word, one, pair, two, triple = _counted(chunk, right, tuning=False)
        base = np.log10((word + 1) / (n_all + v_all + 1))
        at = buckets(one, two)
        p = weights[at, 3] / (v_all + 1) + weights[at, 2] * word / max(n_all, 1)
        p += weights[at, 1] * pair / np.maximum(one, 1)
        p += weights[at, 0] * triple / np.maximum(two, 1)
        rows = len(chunk.fold)
        return pa.table(
            {
                "doc_id": chunk.rows.column("doc_id"), "held_out": pa.array(chunk.fold == 2), "n_tokens": np.diff(chunk.ptr), "n_known": sums((word > 0).astype(np.int64), chunk.ptr),
                "train_tokens": np.full(rows, n_all), "base_score": _by_text(base, chunk.ptr), "score": _by_text(np.log10(p), chunk.ptr),
            }
        )

    return _met(chunked, answers, score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _by_text(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of each text's values; every text has an end token."""
    return np.add.reduceat(x, ptr[:-1]) if len(ptr) > 1 else np.zeros(0)


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
