"""SentencePiece BPE encoding and decoding by suffix-array matching.

For each batch the distinct words not seen before are concatenated and their suffixes sorted;
every piece is binary-searched for its range of occurrences, which gives all edges (start,
piece, end). The edges are sorted by position and relaxed from left to right. A boundary
between two pieces is right exactly if running the merges over both texts together never crosses it, and
that depends on the two pieces alone. So a prefix's encoding ends with the one piece that is
compatible with the encoding before it, and relaxing needs no scores beyond the merge ranks.

The model file is a parameter; models with identity normalisation, a dummy prefix and byte
fallback are supported. A null text has null ids, an empty one none. U+2581 in a text is read as a space,
as the format has it; any other text decodes to itself.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import SMALL, slices, span_hashes, tidied

U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
INF = np.int64(1) << 40
CACHE_WORDS = 400_000
NEW_BYTES = 1 << 18  # of new words that are encoded at once: each byte starts several pieces, which are held as edges


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; value: int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model's pieces, their merges, and tables of how each piece comes about."""

    def __init__(self, model: bytes) -> None:
        texts, scores, kinds = [], [], []
        kind, charsmap = 1, b""
        for number, value in _fields(model):
            if number == 2:
                kind = dict(_fields(value)).get(3, 1)
            if number == 3:
                charsmap = dict(_fields(value)).get(2, b"")
            if number == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, 1))
        if kind != 2 or charsmap or sum(k == 6 for k in kinds) != 256:
            raise ValueError("only BPE models with byte fallback and without a character map are supported")
        self.n = len(texts)
        normal = [i for i in range(self.n) if kinds[i] == 1]
        self.bytes_ = [b""] * self.n
        self.byte_id = np.full(256, -1, np.int32)
        for i, t in enumerate(texts):
            if kinds[i] == 6:
                self.byte_id[int(t[3:5], 16)] = i
                self.bytes_[i] = bytes([int(t[3:5], 16)])
            elif kinds[i] == 1:
                self.bytes_[i] = t.replace(MARK, " ").encode()
        self.id = {texts[i]: i for i in normal}
        self.texts, self.scores = texts, scores
        # equal scores have equal ranks
        _, rank = np.unique([-scores[i] for i in normal], return_inverse=True)
        self.rank = np.full(self.n, INF)
        self.rank[normal] = rank
        self._merge_tables(normal)
        self._search_tables([i for i in normal if self.whole[i]])

    def _run(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """The merges over a text alone: its symbols at the end, and (rank, leftmost, rightmost symbol) after each merge."""
        sym, nxt, prev = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        heap: list[tuple[int, int, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and nxt[a] >= 0 and (i := self.id.get(sym[a] + sym[nxt[a]])) is not None:
                heapq.heappush(heap, (int(self.rank[i]), a, nxt[a], sym[a] + sym[nxt[a]]))

        for a in range(len(text)):
            offer(a)
        events, last = [], len(text) - 1
        while heap:
            r, a, b, made = heapq.heappop(heap)
            if not sym[a] or not sym[b] or nxt[a] != b or sym[a] + sym[b] != made:
                continue
            sym[a], sym[b], nxt[a] = made, "", nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            else:
                last = a
            events.append((r, sym[0], sym[last]))
            offer(prev[a])
            offer(a)
        return [s for s in sym if s], events

    def _merge_tables(self, normal: list[int]) -> None:
        odd: dict[str, int] = {}  # characters of pieces that aren't pieces

        def number(s: str) -> int:
            return self.id[s] if s in self.id else odd.setdefault(s, self.n + len(odd))

        runs = {}
        self.whole = np.zeros(self.n, bool)
        for i in normal:
            end, events = self._run(self.texts[i])
            self.whole[i] = len(end) == 1
            runs[i] = events
        depth = max(len(e) for e in runs.values()) + 1
        self.when = np.full((self.n, depth), INF)
        self.left = np.zeros((self.n, depth), np.int64)
        self.right = np.zeros((self.n, depth), np.int64)
        for i, events in runs.items():
            t = self.texts[i]
            self.left[i], self.right[i] = number(t[0]), number(t[-1])
            for k, (r, a, b) in enumerate(events):
                self.when[i, k] = r
                self.left[i, k + 1 :], self.right[i, k + 1 :] = number(a), number(b)
        pairs = {}
        self.width = self.n + len(odd) + 1
        for i in normal:
            t = self.texts[i]
            for k in range(1, len(t)):
                if all(len(s) == 1 or s in self.id for s in (t[:k], t[k:])):
                    pairs[number(t[:k]) * self.width + number(t[k:])] = int(self.rank[i])
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[int(k)] for k in self.pair], np.int64)
        self.known = np.zeros(0, np.int64)
        self.known_right = np.zeros(0, bool)

    def _search_tables(self, ids: list[int]) -> None:
        """Sorted by first eight bytes: the least and greatest keys of suffixes that a piece can start."""
        self.search = np.array(ids, np.int64)
        self.length = np.array([len(b) for b in self.bytes_], np.int64)
        self.low = np.array([int.from_bytes(self.bytes_[i][:8].ljust(8, b"\0"), "big") for i in ids], U)
        self.high = np.array([int.from_bytes(self.bytes_[i][:8].ljust(8, b"\xff"), "big") for i in ids], U)
        self.pool = np.frombuffer(b"".join(self.bytes_), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of a and b together leaves their boundary. Answers are kept."""
        key = a * self.n + b
        if len(self.known) > 4_000_000:
            self.known, self.known_right = self.known[:0], self.known_right[:0]
        asked = np.unique(key)
        new = asked[~_among(self.known, asked)]
        if len(new):
            right = np.concatenate([self._decide(new[i : i + 50_000] // self.n, new[i : i + 50_000] % self.n) for i in range(0, len(new), 50_000)])
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known = np.concatenate([self.known, new])[order]
            self.known_right = np.concatenate([self.known_right, right])[order]
        return self.known_right[np.searchsorted(self.known, key)]

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            wa, wb = self.when[x, i[live]], self.when[y, j[live]]
            key = self.right[x, i[live]] * self.width + self.left[y, j[live]]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            cross = np.where(self.pair[at] == key, self.pair_rank[at], INF)
            crossed = (cross < wa) & (cross <= wb) & (cross < INF)  # at equal rank the leftmost merge goes first
            out[live[crossed]] = False
            go = ~crossed & ((wa < INF) | (wb < INF))
            first = wa <= wb
            i[live[go & first]] += 1
            j[live[go & ~first]] += 1
            live = live[go]
        return out


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(asked), bool)
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... (size[i] numbers) for each i."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def encode_words(p: Pieces, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words text[starts:ends], with pointers. A word has a space only at its front."""
    size = ends - starts
    n = int(size.sum()) + len(size)
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # words stand apart by a byte that no UTF-8 has
    joined = np.full(n + 8, 255, np.uint8)
    joined[_spread(base, size)] = text[_spread(starts, size)]
    head = np.flatnonzero(((joined[:n] & 0xC0) != 0x80) & (joined[:n] != 255))
    wide = np.zeros(len(head), U)
    for k in range(8):
        wide = (wide << U(8)) | joined[head + k].astype(U)
    order = np.argsort(wide, kind="stable")
    suffix, wide = head[order], wide[order]
    low, high = np.searchsorted(wide, p.low, "left"), np.searchsorted(wide, p.high, "right")
    hits = high - low
    start = suffix[_spread(low, hits)]
    piece = np.repeat(p.search, hits)
    long = np.flatnonzero(p.length[piece] > 8)
    if len(long):  # the rest of long pieces is compared byte by byte
        keep = np.ones(len(piece), bool)
        far = np.concatenate([joined, np.zeros(int(p.length.max()), np.uint8)])
        for k in range(8, int(p.length.max())):
            on = long[p.length[piece[long]] > k]
            keep[on] &= far[start[on] + k] == p.pool[p.at[piece[on]] + k]
        start, piece = start[keep], piece[keep]
    # characters that no piece has: one edge each, later spelt in bytes
    covered = np.zeros(n + 1, bool)
    follow = np.append(head[1:], n)
    char = np.minimum(follow, n) - head
    char -= joined[np.minimum(head + char - 1, n - 1)] == 255
    single = p.length[piece] == (char[np.searchsorted(head, start)] if len(start) else 0)
    covered[start[single]] = True
    lone = ~covered[head]
    start = np.concatenate([start, head[lone]])
    stop = np.concatenate([start[: len(piece)] + p.length[piece], head[lone] + char[lone]])
    piece = np.concatenate([piece, np.full(int(lone.sum()), -2)])
    word = np.searchsorted(base, start, "right") - 1
    depth = start - base[word]
    order = np.argsort(depth, kind="stable")
    start, stop, piece, depth = start[order], stop[order], piece[order], depth[order]
    last = np.full(n + 1, -3, np.int64)  # -3: not reached
    back = np.zeros(n + 1, np.int64)
    last[base] = -1
    cuts = np.flatnonzero(np.diff(depth)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)], strict=True):
        before = last[start[a:b]]
        on = np.flatnonzero(before > -3)
        before, new = before[on], piece[a:b][on]
        real = (before >= 0) & (new >= 0)
        good = np.ones(len(on), bool)
        if real.any():
            good[real] = p.compatible(before[real], new[real])
        on = on[good]
        last[stop[a:b][on]] = piece[a:b][on]
        back[stop[a:b][on]] = start[a:b][on]
    # walk back from all word ends at once
    at = base + size
    rows = np.arange(len(base))
    back_rows, back_at, back_piece = [], [], []
    live = size > 0
    rows, at = rows[live], at[live]
    while len(rows):
        if (last[at] == -3).any():
            raise ValueError("a word has no encoding")
        back_rows.append(rows)
        back_at.append(back[at])
        back_piece.append(last[at])
        at = back[at]
        more = at > base[rows]
        rows, at = rows[more], at[more]
    if not back_rows:
        return np.zeros(0, np.int32), np.zeros(len(base) + 1, np.int64)
    row, at, ids = np.concatenate(back_rows), np.concatenate(back_at), np.concatenate(back_piece)
    order = np.argsort(at, kind="stable")
    row, at, ids = row[order], at[order], ids[order]
    width = np.where(ids == -2, char[np.searchsorted(head, at)], 1)
    flat = np.repeat(ids, width)
    unknown = np.flatnonzero(flat == -2)
    if len(unknown):
        spelt = p.byte_id[joined[_spread(at[ids == -2], width[ids == -2])]]
        flat[unknown] = spelt
    count = np.bincount(row, width, len(base)).astype(np.int64)
    return flat.astype(np.int32), np.concatenate([[0], np.cumsum(count)])


def encode_new(p: Pieces, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_words``, about NEW_BYTES at a time."""
    group = np.cumsum(ends - starts) // NEW_BYTES
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(starts)).tolist()
    made = [encode_words(p, text, starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.concatenate([flat for flat, _ in made]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(ptr) for _, ptr in made]))])


class Encoder:
    """Encodes slices of texts; keeps the ids of up to CACHE_WORDS distinct words."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.clear()
        self.alone = np.zeros(256, bool)  # ASCII characters that no piece has end a word and are words of their own
        for b in range(128):
            self.alone[b] = chr(b) not in pieces.id and b != 32

    def clear(self) -> None:
        self.hash, self.flat, self.ptr = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, pointers, normalised bytes, their offsets) of the texts."""
        data, offsets = _prefixed(data, offsets)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), data, offsets
        space = data == 32
        alone = self.alone[data]
        begin = np.zeros(n, bool)
        begin[offsets[:-1][offsets[:-1] < n]] = True
        begin[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        hashed = span_hashes(data, starts, ends)
        uniq, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        new = ~_among(self.hash, uniq)
        if new.any():
            if len(self.hash) + int(new.sum()) > CACHE_WORDS:
                self.clear()
                new = np.ones(len(uniq), bool)
            flat, ptr = encode_new(self.p, data, starts[first[new]], ends[first[new]])
            order = np.argsort(np.concatenate([self.hash, uniq[new]]), kind="stable")
            size = np.concatenate([np.diff(self.ptr), np.diff(ptr)])
            start = np.concatenate([self.ptr[:-1], ptr[:-1] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])[_spread(start[order], size[order])]
            self.hash = np.concatenate([self.hash, uniq[new]])[order]
            self.ptr = np.concatenate([[0], np.cumsum(size[order])])
        where = np.searchsorted(self.hash, uniq)[inverse]
        size = (self.ptr[1:] - self.ptr[:-1])[where]
        ids = self.flat[_spread(self.ptr[where], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(starts, offsets)], data, offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a flat run of ids, spaces for marks, with the leading spaces of the texts."""
        return self.p.pool[_spread(self.p.at[ids], self.p.length[ids])]


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with marks as spaces and a space in front of each that isn't empty."""
    if len(data) > 2:
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(mark):
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            data = data.copy()
            data[mark] = 32
            kept = np.concatenate([[0], np.cumsum(keep)])
            data, offsets = data[keep], kept[offsets]
    size = np.diff(offsets)
    out = np.concatenate([[0], np.cumsum(size + (size > 0))])
    text = np.full(int(out[-1]), 32, np.uint8)
    text[_spread(out[1:] - size, size)] = data
    return text, out


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(Pieces(model))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", check: bool = False) -> DataFrame:
    """docs with ids: array<int>, and with ``check`` also round_trip: whether the ids decode to the text.

    The model file (half a megabyte) is read on the driver and sent with the tasks.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_model(model))
    docs = docs.drop("ids", "round_trip")
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("round_trip", T.BooleanType())] if check else [])]

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(text), 2 * SMALL):
                ids, ptr, norm, off = enc.encode(data, offsets)
                null = batch.column(text).slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                arrays = [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids), mask=pa.array(null))]
                if check:
                    size = np.concatenate([[0], np.cumsum(enc.p.length[ids])])[ptr]
                    back = enc.decode(ids)
                    same = np.diff(size) == np.diff(off)
                    if len(back) == len(norm):
                        wrong = np.concatenate([[0], np.cumsum(back != norm)])
                        same &= np.diff(wrong[off]) == 0
                    arrays.append(pa.array(same, mask=null))
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(lambda it: tidied(run(it)), T.StructType([*docs.schema.fields, *fields]))


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """df with ``decoded``: the text of each row's ids; null for null. Bytes that are no UTF-8 become U+FFFD."""
    spec = df.sparkSession.sparkContext.broadcast(read_model(model))
    df = df.drop("decoded")

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            col = batch.column(ids)
            out = []
            for row in col:
                if not row.is_valid:
                    out.append(None)
                else:
                    got = enc.decode(row.values.to_numpy(zero_copy_only=False).astype(np.int64)).tobytes()
                    out.append(got[1:].decode("utf-8", "replace") if got[:1] == b" " else got.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).selectExpr("doc_id", "size(ids) as n_ids", "ids", "round_trip")
