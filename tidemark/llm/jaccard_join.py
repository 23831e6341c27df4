"""Exact n-gram Jaccard join by signature trees.

Sets are the distinct word n-grams of a text. Two documents link when
``den * |A & B| >= num * |A | B|``. The work is dealt out in four steps:

1. Equal sets are one class, named by a 64-bit sum of their mixed hashes.
2. Candidate families. |A ^ B| <= (den-num)/(den+num) * (|A|+|B|) for a linked pair, so if the
   hash space is cut into H+1+spare blocks (H: that bound for the larger sizes of a size band),
   at least spare+1 blocks hold the same elements in both. A document emits one signature for each
   block's whole content; documents that share a signature are candidates. ``spare`` lets a
   document leave a few signatures that very many documents share (a common line alone in its
   block), or empty blocks, without losing a link. Linked sets lie in the same size band or in neighbouring
   ones, so a document has signatures for its own band (slot 0) and, if needed, for the next one (slot 1); both
   slots meet, and the slot only says which spare ones a frequent signature counts against.
   Signatures are packed in sorted cells and dealt by hash range; a range tells only those that several classes
   share. One that is frequent within a chunk of documents is known to be frequent, so the chunk keeps it to
   itself and only sends its count: no range gets all rows of a hot signature.
   Documents of one signature are then held against each other by the numbers of their elements in a few dozen
   parts of the hash space: sets differ in at least as many elements as these numbers do, so most documents that only have
   a passage in common part here, losslessly and without their texts.
3. A family (a connected component of candidates) is searched by a signature tree: nodes hold the
   OR of their documents' token bitmaps and their range of sizes, and a dual traversal drops node
   pairs whose maximum possible overlap is too small. What is left is verified exactly. Pairs that
   are already connected are skipped, so a group of near copies needs no list of all its pairs.
4. A family of more than ``unit_tokens`` set elements is dealt to blocks by hash, which are searched
   alone first. Then only documents with a signature whose holders aren't one component yet are
   searched again, in families of their own. Such a family that is still too large is searched head by head: linked sets are candidates of
   one head. Only the candidates of a single head that are too large by themselves are searched by pairs of blocks.

Null or wordless texts have an empty set and link with nothing. Rows are told apart by doc_id and text, so
repeated doc_ids and null ids may have any texts; a null doc_id never is a component's smallest id unless all are null.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import cells, deal, levels_of, unpack
from .graph import beside, components, cut
from .text import SMALL, distinct, mix64, shingles, slices, sums, tidied, word_hashes

U = np.uint64
FREQUENT = 32
BAND = 1.6
CHUNK_BYTES = 4 << 20
RANGE_ENTRIES = 1_000_000
CHUNK_ENTRIES = 250_000  # about so many signatures a chunk has


def _bands(num: int, den: int, top: int = 1 << 34) -> np.ndarray:
    """Lower ends of the size bands; each is wider than den/num, so a pair spans two at most."""
    ends, ratio = [1], max(BAND, 1.02 * den / num)
    while ends[-1] < top:
        ends.append(int(ends[-1] * ratio) + 1)
    return np.array(ends, np.int64)


def _signatures(h: np.ndarray, ptr: np.ndarray, num: int, den: int, bands: np.ndarray) -> tuple[np.ndarray, ...]:
    """Block signatures of sets: (signature, slot, pointers, spare of slot 0, of slot 1).

    Slot 0 is the set's own band; slot 1 the next one, if a linked set can be in it.
    """
    n = np.diff(ptr)
    own = np.searchsorted(bands, n, "right") - 1
    most = n * den // num
    lonely = (den - num) * (n + most) < den + num  # no unequal set can link
    nxt = np.where(bands[np.minimum(own + 1, len(bands) - 1)] <= most, own + 1, -1)
    doc = np.concatenate([np.flatnonzero(~lonely & (n > 0)), np.flatnonzero(~lonely & (nxt >= 0))])
    slot = np.zeros(len(doc), np.int64)
    slot[(~lonely & (n > 0)).sum() :] = 1
    order = np.lexsort((slot, doc))
    doc, slot = doc[order], slot[order]
    band = np.where(slot == 0, own[doc], nxt[doc])
    high = bands[band + 1] - 1
    differ = (den - num) * 2 * high // (den + num)
    # enough for the empty blocks of nearly all sets: those of a set with more would be signatures that all such sets share
    spare = 3 + differ // 6
    blocks = differ + 1 + spare
    base = np.zeros(len(doc) + 1, np.int64)
    np.cumsum(blocks, out=base[1:])
    size = n[doc]
    start = np.zeros(len(doc) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    at = np.arange(start[-1]) + np.repeat(ptr[doc] - start[:-1], size)
    m = mix64(h[at] ^ U(0xA5A5A5A55A5A5A5A))
    cell = np.repeat(base[:-1], size) + (mix64(m) % np.repeat(blocks, size).astype(U)).astype(np.int64)
    cells = int(base[-1])
    low = np.bincount(cell, (m & U(0xFFFFFFFF)).astype(float), cells).astype(U)
    high_half = np.bincount(cell, (m >> U(32)).astype(float), cells).astype(U)
    count = np.bincount(cell, minlength=cells)
    owner = np.repeat(np.arange(len(doc)), blocks)
    place = np.arange(cells) - base[owner]
    sig = mix64(low + (high_half << U(32)) + mix64(band[owner].astype(U) * U(0x100000001B3) + place.astype(U) + (count.astype(U) << U(40))))
    empty = count == 0
    empties = np.bincount(owner[empty], minlength=len(doc))
    keep = ~empty | (empties > spare)[owner]
    left = np.maximum(spare - empties, 0)
    of = doc[owner[keep]]
    counts = np.bincount(of, minlength=len(n))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    spares = np.zeros((2, len(n)), np.int64)
    spares[slot, doc] = left
    return sig[keep], slot[owner[keep]], out, spares[0], spares[1]


def _sets(texts: pa.Array | pa.ChunkedArray, words: int):
    """(first row, end row, hashes, pointers, class names) of the sets of texts."""
    for a, b, data, offsets in slices(texts, SMALL):
        h, ptr = distinct(*shingles(*word_hashes(data, offsets), words))
        yield a, b, h, ptr, _names(h, ptr)


def _names(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return mix64(sums(mix64(h ^ U(1)), ptr) + np.diff(ptr).astype(U)).view(np.int64)


COARSE, FINE = 8, 2  # elements of a band's smallest set for each part of a profile


def _profile_bits(n: np.ndarray, bands: np.ndarray, each: int = COARSE) -> np.ndarray:
    """log2 of the parts of the hash space for the profiles of sets of n elements: one for ``each`` elements of the band's smallest, or fewer."""
    low = bands[np.maximum(np.searchsorted(bands, n, "right") - 1, 0)]
    return np.clip(np.ceil(np.log2(np.maximum(low, 1) / each)), 4, 12).astype(np.int64)


def _profiles(h: np.ndarray, ptr: np.ndarray, bands: np.ndarray, each: int = COARSE) -> list[bytes]:
    """How many elements each set has in each part of the hash space."""
    n = np.diff(ptr)
    bits = _profile_bits(n, bands, each)
    start = np.concatenate([[0], np.cumsum(1 << bits)])
    row = np.repeat(np.arange(len(n)), n)
    m = mix64(h ^ U(0xC3C3C3C3))
    at = start[row] + (m >> (U(64) - bits[row].astype(U))).astype(np.int64)
    flat = np.minimum(np.bincount(at, minlength=start[-1]), 255).astype(np.uint8).tobytes()
    return [flat[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _near(profiles: list[bytes], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each of a star's sets the first that it is connected with by pairs whose profiles leave a link possible."""
    parts, m = min(map(len, profiles)), len(n)
    # counts and their sums are whole numbers below 2^24, which floats hold exactly
    v = np.stack([np.frombuffer(x, np.uint8).reshape(parts, -1).sum(1, dtype=np.int32) for x in profiles]).astype(np.float32)
    ones, root = np.ones(parts, np.float32), np.arange(m)
    if m * m * parts <= 1 << 19:  # all at once; labels spread until they stay
        near = (np.abs(v[:, None] - v) @ ones).astype(np.int64) * (den + num) <= (den - num) * (n[:, None] + n)
        while True:
            least = np.where(near, root, m).min(1)
            if (least == root).all():
                return root
            root = least
    step = max(1, (1 << 20) // parts)
    for i in range(1, m):
        # a set that is connected with i needs no second look, but each group must be met
        apart = np.flatnonzero(root[:i] != root[i])
        met = [np.zeros(0, np.int64)]
        for k in range(0, len(apart), step):
            some = apart[k : k + step]
            far = (np.abs(v[some] - v[i]) @ ones).astype(np.int64) * (den + num) > (den - num) * (n[some] + n[i])
            met.append(root[some[~far]])
        met = np.unique(np.concatenate(met))
        if len(met):
            root[np.isin(root, np.append(met, root[i]))] = min(int(met[0]), int(root[i]))
    return root


def _parted(table: pa.Table, num: int, den: int, apart: bool = False) -> pa.Table:
    """Edges (u, v) from candidates of heads to the first candidate that they are near to.

    apart: stars (u, v) of those that are near to each other instead, named by their members: groups of several heads that have a
    candidate in common stay several, and those of the same candidates are one.
    """
    order = np.lexsort((table.column("u").to_numpy(), table.column("v").to_numpy()))
    v, u, n = (table.column(k).to_numpy()[order] for k in ("v", "u", "n"))
    profile = table.column("profile").to_pylist()
    edges = np.append(np.flatnonzero(np.diff(v, prepend=~v[:1])), len(v)).tolist()
    first = np.arange(len(u))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        first[a:b] = a + _near([profile[k] for k in order[a:b]], n[a:b], num, den)
    if apart:
        name, count = np.zeros(len(u), U), np.bincount(first, minlength=len(u))
        np.add.at(name, first, mix64(u.view(U) ^ U(0x57A257A2)))
        keep = count[first] > 1
        return pa.table({"u": u[keep], "v": _virtual(name[first[keep]])})
    keep = first != np.arange(len(u))
    return pa.table({"u": u[keep], "v": u[first[keep]]})


def _summaries(batches, words: int, num: int, den: int):
    bands = _bands(num, den)
    for batch in batches:
        for a, b, h, ptr, name in _sets(batch.column("text"), words):
            _, _, sp, spare0, spare1 = _signatures(h, ptr, num, den, bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(np.diff(ptr)), pa.array(name), pa.array(spare0), pa.array(spare1), pa.array(np.diff(sp)), pa.array(_profiles(h, ptr, bands), pa.binary()), pa.array(_profiles(h, ptr, bands, FINE), pa.binary())],
                ["doc_id", "key", "n", "name", "spare0", "spare1", "m", "profile", "fine"],
            )


SUMMARY = "doc_id long, key long, n long, name long, spare0 long, spare1 long, m long, profile binary, fine binary"
LOCAL = 1 << 30  # ranges from here on hold what a chunk found to be frequent
TOLD = "u long, v long, slot int, loud boolean, c long"


def _virtual(value: np.ndarray) -> np.ndarray:
    """The node that stands for a frequent signature."""
    return mix64(value ^ U(0x5EED0F1E55)).view(np.int64)


def _dealt(batches, words: int, num: int, den: int, bits: int, width: int):
    """Cells (p, g, n, value, node, slot, weight) of chunks of documents."""
    bands = _bands(num, den)
    part = TaskContext.get().partitionId()
    held, size, made = [], 0, 0

    def packed():
        g = (part << 20) + made
        name, value, slot = (np.concatenate(x) for x in zip(*held, strict=True))
        # of equal sets in a chunk one is enough; slot 1 is told apart, as it counts against other spares
        order = np.lexsort((slot, name, value))
        name, value, slot = name[order], value[order], slot[order]
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (value[1:] != value[:-1])
        name, value, slot = name[fresh], value[fresh], slot[fresh]
        heads = np.flatnonzero(np.diff(value, prepend=~value[:1]))
        count = np.diff(np.append(heads, len(value)))
        loud = np.repeat(count > FREQUENT, count)
        first = np.zeros(len(value), bool)
        first[heads] = True
        weight = np.where(loud, np.repeat(count, count), 1).astype(np.uint32)
        node = np.where(loud, 0, name)
        keep = ~loud | first
        yield from cells(value[keep], g, bits, {"node": node[keep].view(U), "slot": slot[keep].astype(np.uint8), "weight": weight[keep]}, width)
        if loud.any():
            yield from cells(value[loud], g, 0, {"node": name[loud].view(U), "slot": slot[loud].astype(np.uint8), "weight": weight[loud]}, width, LOCAL + g % LOCAL)

    for batch in batches:
        for a, b, h, ptr, name in _sets(batch.column("text"), words):
            _, once = np.unique(name, return_index=True)
            if len(once) < len(name):
                once.sort()
                at = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in once]) if len(once) else np.zeros(0, np.int64)
                h, ptr, name = h[at], np.concatenate([[0], np.cumsum(np.diff(ptr)[once])]), name[once]
            sig, slot, sp, _, _ = _signatures(h, ptr, num, den, bands)
            if len(sig):
                held.append((np.repeat(name, np.diff(sp)), sig >> U(64 - width) << U(64 - width), slot))
            size += int(batch.column("text").slice(a, b - a).nbytes)
            if size >= CHUNK_BYTES and held:
                yield from packed()
                held, size, made = [], 0, made + 1
    if held:
        yield from packed()


def _shared(table: pa.Table) -> pa.Table:
    """(node, head, slot, loud, c) of one range's signatures that several classes have; c: how many with the same head a class has."""
    if table.column("p")[0].as_py() >= LOCAL:
        value, node, slot = unpack(table, "value"), unpack(table, "node"), unpack(table, "slot")
        return pa.table({"u": node.view(np.int64), "v": _virtual(value), "slot": slot.astype(np.int32), "loud": np.ones(len(value), bool), "c": np.ones(len(value), np.int64)})
    value, node, slot, weight = (unpack(table, k) for k in ("value", "node", "slot", "weight"))
    order = np.lexsort((node, value))
    value, node, slot, weight = value[order], node[order], slot[order], weight[order].astype(np.int64)
    again = np.zeros(len(value), bool)  # the same class in another chunk; counts of frequent ones add up
    again[1:] = (value[1:] == value[:-1]) & (node[1:] == node[:-1]) & (node[1:] != 0)
    value, node, slot, weight = value[~again], node[~again], slot[~again], weight[~again]
    heads = np.flatnonzero(np.diff(value, prepend=~value[:1]))
    count = np.diff(np.append(heads, len(value)))
    total = np.repeat(np.add.reduceat(weight, heads), count) if len(heads) else weight
    head = np.repeat(node[heads], count).view(np.int64)
    loud = total > FREQUENT
    tell = (total > 1) & (node != 0)
    u, v, slot, loud = node[tell].view(np.int64), np.where(loud, _virtual(value), head)[tell], slot[tell].astype(np.int32), loud[tell]
    order = np.lexsort((slot, v, u))
    u, v, slot, loud = u[order], v[order], slot[order], loud[order]
    heads = np.flatnonzero((np.diff(u, prepend=~u[:1]) != 0) | (np.diff(v, prepend=~v[:1]) != 0) | (np.diff(slot, prepend=~slot[:1]) != 0))
    return pa.table({"u": u[heads], "v": v[heads], "slot": slot[heads], "loud": loud[heads], "c": np.diff(np.append(heads, len(u)))})


FAN, WORDS64 = 8, 16
DENSE_BYTES = 1 << 25
STAR = 4096  # candidates of one head that are held against each other by their profiles
PROFILE_ROWS = 10_000  # candidates in a task


class _Forest:
    """Union-find over the rows of a unit; ``root`` always holds each row's smallest linked row."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray, told: bool = True) -> None:
        pairs = np.unique(np.stack([self.root[a], self.root[b]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                x, y = min(x, y), max(x, y)
                self.up[y] = x
                if told:
                    self.edges.append((x, y))
        self.root = np.array([self.find(x) for x in self.up])


class _Tree:
    """Nodes over documents in a given order; level 0 are the documents themselves."""

    def __init__(self, bits: np.ndarray, size: np.ndarray) -> None:
        slack = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, slack)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack = self.levels[-1]
            cut_at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, cut_at), np.minimum.reduceat(low, cut_at), np.maximum.reduceat(high, cut_at), np.maximum.reduceat(slack, cut_at)))


def _possible(tree: _Tree, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a document under a and one under b can link, by the most that they can have in common.

    x & y has at most one element for each bit that both nodes have set, and besides as many
    as x (or y) has more elements than bits.
    """
    bits, low, high, slack = tree.levels[level]
    fits = (low[a] * den >= 0) & (num * low[a] <= den * high[b]) & (num * low[b] <= den * high[a])
    shared = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64)
    most = np.minimum(shared + np.minimum(slack[a], slack[b]), np.minimum(high[a], high[b]))
    return fits & (most * (num + den) >= num * (low[a] + low[b]))


def _pairs(tree: _Tree, level: int, a: np.ndarray, b: np.ndarray, forest: _Forest, num: int, den: int):
    """Document pairs that the traversal can't rule out, in pieces of bounded size."""
    for i in range(0, len(a), 1 << 15):
        x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
        if level == 0:
            apart = (x < y) & (forest.root[x] != forest.root[y])
            x, y = x[apart], y[apart]
        keep = _possible(tree, level, x, y, num, den)
        x, y = x[keep], y[keep]
        if level == 0:
            yield x, y
            continue
        n = len(tree.levels[level - 1][1])
        step = np.arange(FAN)
        for j in range(0, len(x), 1 << 12):
            p = (x[j : j + (1 << 12), None, None] * FAN + step[:, None] + 0 * step).ravel()
            q = (y[j : j + (1 << 12), None, None] * FAN + 0 * step[:, None] + step).ravel()
            there = (p < n) & (q < n) & (p <= q)
            yield from _pairs(tree, level - 1, p[there], q[there], forest, num, den)


class _Overlaps:
    """Sizes of intersections of rows: by bitmaps of the elements that two rows or more have, or by merging if these are large."""

    def __init__(self, h: np.ndarray, ptr: np.ndarray, order: np.ndarray) -> None:
        values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[inverse] > 1
        row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[shared]
        at = number[inverse[shared]]
        lanes = max(1, (int(number[-1]) + 1 + 63) // 64 if len(number) else 0)
        self.bits = None
        if len(order) * lanes * 8 <= DENSE_BYTES:
            bits = np.zeros((len(ptr) - 1, lanes), U)
            np.bitwise_or.at(bits, (row, at >> 6), U(1) << (at & 63).astype(U))
            self.bits = bits[order]
            self.step = max(1, (1 << 20) // lanes)
        else:
            size = np.bincount(row, minlength=len(ptr) - 1)
            start = np.concatenate([[0], np.cumsum(size)])
            self.start, self.size, self.at = start[:-1][order], size[order], at
            self.step = max(1, (1 << 19) // max(1, int(size.max())))

    def _flat(self, x: np.ndarray) -> np.ndarray:
        n = self.size[x]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (np.repeat(np.arange(len(x)), n) << 32) | self.at[np.repeat(self.start[x], n) + step]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[x] & self.bits[y]).sum(1).astype(np.int64)
        both = np.intersect1d(self._flat(x), self._flat(y), assume_unique=True)
        return np.bincount(both >> 32, minlength=len(x))


def tree_links(h: np.ndarray, ptr: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest that connects the sets as their links do (an edge may join two sets by way of others).

    known: labels of rows that are connected already.
    """
    size = np.diff(ptr).astype(np.int64)
    if len(size) < 2:
        return []
    bits = np.zeros((len(size), WORDS64), U)
    row = np.repeat(np.arange(len(size)), size)
    at = (mix64(h) >> U(54)).astype(np.int64)
    np.bitwise_or.at(bits, (row, at >> 6), U(1) << (at & 63).astype(U))
    first = np.full(len(size), np.iinfo(np.uint64).max, U)
    np.minimum.at(first, row, mix64(h ^ U(7)))
    order = np.lexsort((first, size))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    forest = _Forest(len(size))
    if known is not None:
        _, head, label = np.unique(known[order], return_index=True, return_inverse=True)
        forest.link(np.arange(len(order)), head[label], told=False)
    overlaps = _Overlaps(h, ptr, order)
    parts = np.zeros((len(order), 128), np.uint16)
    np.add.at(parts, (row, (mix64(h ^ U(0xC3C3C3C3)) >> U(57)).astype(np.int64)), 1)
    parts = parts[order].astype(np.int32)
    size = size[order]
    tree = _Tree(bits[order], size)
    top = len(tree.levels) - 1
    root = np.zeros(1, np.int64)
    for a, b in _pairs(tree, top, root, root, forest, num, den):
        for i in range(0, len(a), overlaps.step):
            x, y = a[i : i + overlaps.step], b[i : i + overlaps.step]
            apart = forest.root[x] != forest.root[y]
            x, y = x[apart], y[apart]
            near = np.concatenate([np.abs(parts[x[k : k + 8192]] - parts[y[k : k + 8192]]).sum(1, dtype=np.int64) for k in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])
            near = near * (den + num) <= (den - num) * (size[x] + size[y])
            x, y = x[near], y[near]
            common = overlaps(x, y)
            linked = den * common >= num * (size[x] + size[y] - common)
            if linked.any():
                forest.link(x[linked], y[linked])
    return [(int(order[a]), int(order[b])) for a, b in forest.edges]


def _search(table: pa.Table, words: int, num: int, den: int) -> pa.Table:
    """A forest (u, v) that connects one unit's classes as their links do."""
    nodes, sets, labels, seen = [], [], [], set()
    node, known = table.column("node").to_numpy(), table.column("known").to_numpy()
    for a, b, h, ptr, name in _sets(table.column("text"), words):
        for r in range(b - a):
            if name[r] == node[a + r] and name[r] not in seen:
                seen.add(name[r])
                nodes.append(node[a + r])
                sets.append(h[ptr[r] : ptr[r + 1]])
                labels.append(known[a + r])
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    edges = tree_links(np.concatenate(sets) if sets else np.zeros(0, U), ptr, num, den, np.array(labels))
    return pa.table({"u": pa.array([int(nodes[a]) for a, _ in edges], pa.int64()), "v": pa.array([int(nodes[b]) for _, b in edges], pa.int64())})


def _links(docs: DataFrame, members: DataFrame, keys: list[str], words: int, num: int, den: int) -> DataFrame:
    """members: node, known, the unit's keys, and doc_id, key and again of a row with the class's text. Only their texts are dealt out."""
    side = members.withColumnRenamed("doc_id", "__d").withColumnRenamed("key", "__k")
    rows = beside(docs, side, docs.doc_id.eqNullSafe(F.col("__d")) & (docs.key == F.col("__k"))).select("node", "known", "again", *keys, "text")
    # rows of one doc_id and text are all met; where there are any, one is taken before they are dealt
    if not members.where("again").isEmpty():
        one = rows.where("again").groupBy("node", "known", "again", *keys).agg(F.min("text").alias("text"))
        rows = rows.where("not again").unionByName(one)
    return rows.drop("again").groupBy(*keys).applyInArrow(lambda unit: tidied(_search(unit, words, num, den)), "u long, v long")


def _near_stars(stars: DataFrame, facts: DataFrame, profile: str, num: int, den: int, apart: bool = False) -> DataFrame:
    """stars(u, v) whose members are parted by a profile (see ``_parted``). Stars above STAR stay whole."""
    large = cut(stars.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > STAR).select("v"))
    whole = beside(stars, large, "v").where(F.lit(apart) | (F.col("u") != F.col("v"))).select("u", "v")
    small = beside(stars, large, "v", "left_anti").join(facts.select(F.col("node").alias("u"), "n", F.col(profile).alias("profile")), "u")
    small = small.groupBy(F.pmod(F.xxhash64("v"), F.lit(stars.count() // PROFILE_ROWS + 1)).alias("unit"))
    return cut(whole.unionByName(small.applyInArrow(lambda t: tidied(_parted(t, num, den, apart)), "u long, v long")).distinct())


def _with_heads(edges: DataFrame) -> DataFrame:
    """edges and each head as a member of its own star."""
    return edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct())


def _parts(members: DataFrame, unit_tokens: int) -> DataFrame:
    """members with parts, the number of blocks of their family, and part."""
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / unit_tokens).cast("long").alias("parts"))
    return beside(members, cut(sizes), "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))


def _components(docs: DataFrame, words: int, num: int, den: int, unit_tokens: int) -> DataFrame:
    """doc_id, key (hash of the text), n, class_size, keeper (null, doc_id, key: the component's first row, nulls last) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    base = cut(docs.mapInArrow(lambda it: tidied(_summaries(it, words=words, num=num, den=den)), SUMMARY))
    full = base.where("n > 0")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    classes = full.groupBy("name").agg(F.min(first).alias("first"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1"))
    entries = full.agg(F.sum("m")).first()[0] or 0
    bits, width = _scale(entries)
    dealt = docs.select("text").mapInArrow(lambda it: tidied(_dealt(it, words=words, num=num, den=den, bits=bits[0], width=width)), CELLS)
    told = deal(dealt, bits, ["node", "slot", "weight"], entries // CHUNK_ENTRIES, width, LOCAL).groupBy("p").applyInArrow(lambda t: tidied(_shared(t)), TOLD)
    # a frequent signature is a head of its own
    told = cut(told.groupBy("u", "v", "slot", "loud").agg(F.when(F.col("loud"), 1).otherwise(F.sum("c")).alias("c")))
    wanted = cut(told.select(F.col("u").alias("name")).distinct())
    # one row of each class gives its profile, found by its id and text, so that a text of very many exact copies is no hot key
    chosen = cut(classes.join(wanted, "name").withColumnRenamed("name", "node"))
    side = chosen.select("node", F.col("first.doc_id").alias("__d"), F.col("first.key").alias("__k"))
    own = full.select("doc_id", "key", "profile", "fine")
    profiles = beside(own, side, own.doc_id.eqNullSafe(F.col("__d")) & (own.key == F.col("__k"))).groupBy("node").agg(F.min(F.struct("profile", "fine")).alias("p")).select("node", "p.*")
    facts = cut(chosen.join(profiles, "node"))
    # linked sets share more signatures than either has spare ones, so a document that shares fewer with all others together has no link in that
    # slot: most of those that share some by chance go here, before anything wide is told of them
    shared = [F.sum(F.when(F.col("slot") == k, F.col("c"))).alias(f"all{k}") for k in (0, 1)]
    shared += [F.count_if(F.col("loud") & (F.col("slot") == k)).alias(f"loud{k}") for k in (0, 1)]
    keeps = told.groupBy("u").agg(*shared).join(facts, F.col("u") == F.col("node"))
    # of very frequent signatures a document may leave as many as it has spare ones
    keeps = keeps.select("u", *[(F.coalesce(f"all{k}", F.lit(0)) > F.col(f"spare{k}")).alias(f"any{k}") for k in (0, 1)], *[(F.col(f"loud{k}") > F.col(f"spare{k}")).alias(f"keeps{k}") for k in (0, 1)])
    own = lambda name: F.when(F.col("slot") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    some = beside(told, cut(keeps.where("any0 or any1")), "u").where(own("any") & (~F.col("loud") | own("keeps")))
    # stars of candidates: the head is one of them, but where it stands for a frequent signature
    stars = cut(some.select("u", "v").distinct())
    alone = stars.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    stars = cut(stars.join(alone.hint("merge"), "v").select("u", "v"))
    # few candidates are left by the coarse profiles, and only these are held against each other by fine ones
    near = _near_stars(stars, facts, "profile", num, den, apart=True)
    edges = _near_stars(near, facts, "fine", num, den)
    family = components(edges)
    repeated = full.groupBy("doc_id", "key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.lit(True).alias("again"))
    facts = facts.drop("profile", "fine")
    at = facts.join(family, "node").select("node", "n", F.col("component").alias("family"), F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    at = at.join(repeated, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left").drop("__d", "__k")
    members = cut(_parts(at.withColumn("again", F.coalesce("again", F.lit(False))).withColumn("known", F.col("node")), unit_tokens))
    links = cut(_links(docs, members, ["family", "part"], words, num, den))
    large = members.where("parts > 1")
    if not large.isEmpty():
        found = components(links)
        large = cut(large.drop("known", "parts", "part").join(found, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component"))
        # signatures whose holders aren't connected yet; a head is a holder, too, unless it stands for a frequent signature
        held = beside(edges.unionByName(edges.select(F.col("v").alias("u"), "v")), large.select(F.col("node").alias("u"), "known"), "u")
        open_ = held.groupBy("v").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a < b").select("v")
        left = cut(beside(edges, cut(open_), "v").select("u", "v"))
        rest = large.drop("family").join(components(left), "node").withColumnRenamed("component", "family")
        rest = cut(_parts(rest, unit_tokens))
        # linked sets have a head in common: a family of several parts is searched by its heads where that tells fewer texts
        big = rest.where("parts > 1")
        if not big.isEmpty():
            own = big.drop("parts", "part").withColumnRenamed("family", "whole").join(_with_heads(left).withColumnsRenamed({"u": "node", "v": "family"}), "node")
            own = cut(_parts(cut(own), unit_tokens))
            told_ = F.sum(F.greatest(F.lit(1), F.col("parts") - 1)).alias("texts")
            less = own.groupBy("whole").agg(told_).join(big.groupBy(F.col("family").alias("whole")).agg(told_.alias("before")), "whole").where("texts < before").select("whole")
            less = cut(less)
            own = beside(own, less, "whole").select(rest.columns)
            rest = cut(beside(rest, less.withColumnRenamed("whole", "family"), "family", "left_anti").select(rest.columns).unionByName(own))
        if not rest.isEmpty():
            other = F.explode(F.expr("if(parts = 1, array(0L), filter(sequence(0L, parts - 1), x -> x != part))")).alias("other")
            across = rest.select("*", other).withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
            links = links.unionByName(_links(docs, cut(across.select("node", "known", "again", "doc_id", "key", "family", "one", "two")), ["family", "one", "two"], words, num, den))
    found = components(links)
    # only classes of several rows or with links need their component told
    linked = classes.join(found.withColumnRenamed("node", "name"), "name", "left").where("class_size > 1 or component is not null")
    linked = cut(linked.select("name", F.coalesce("component", "name").alias("component"), "class_size", "first"))
    keepers = cut(linked.groupBy("component").agg(F.min("first").alias("keeper")))
    told = cut(beside(linked, keepers, "component").select("name", "class_size", "keeper"))
    nothing = base.where("n = 0").select("doc_id", "key", "n", F.lit(1).cast("long").alias("class_size"), first.alias("keeper"))
    return beside(full, told, "name", "left").select("doc_id", "key", "n", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("keeper", first).alias("keeper")).unionByName(nothing)


CELLS = "p int, g long, n int, value binary, node binary, slot binary, weight binary"


def _scale(entries: int) -> tuple[list[int], int]:
    """Bits of the ranges, level by level, and bits of a signature: at these, documents that share one by chance are rare."""
    bits = max(0, int(np.ceil(np.log2(max(1, entries / RANGE_ENTRIES)))))
    return levels_of(bits, FAN_BITS), min(64, 24 + max(8, int(np.ceil(np.log2(max(1, entries))))))


FAN_BITS = 12  # ranges that one chunk's signatures are dealt to at once


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, unit_tokens: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size for every row of docs(doc_id, text).

    class_size: how many rows have the very same set (1 for empty sets). Other columns of docs are ignored.
    """
    return _components(docs, words, num, den, unit_tokens).select("doc_id", F.col("n").alias("n_shingles"), F.col("keeper.doc_id").alias("component_id"), "class_size")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, unit_tokens: int = 500_000) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id (nulls last) stays.

    Of rows with that doc_id and different texts the one with the smallest hash stays; rows whose text has no words stay.
    Rows with the same doc_id and text can't be told apart and stay or go together.
    """
    all_ = _components(docs.select("doc_id", "text"), words, num, den, unit_tokens)
    gone = all_.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key").eqNullSafe(F.col("keeper.key")))))
    gone = cut(gone.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct())
    rows = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    same = rows.doc_id.cast("long").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k"))
    return beside(rows, gone, same, "left_anti").drop("__key")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, words=4, num=85, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [list_aggregate(l, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(l) - 2), lambda i: concat(l[i], ' ', l[i + 1], ' ', l[i + 2], ' ', l[i + 3])) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT r.a, t.y FROM reach r JOIN both_ways t ON r.b = t.x),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
sizes AS (SELECT list_sort(list(g)) AS k, count(*) AS c, list(doc_id) AS ids FROM (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id) GROUP BY g)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(z.c, 1) AS class_size
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON a = d.doc_id
LEFT JOIN (SELECT unnest(ids) AS doc_id, c FROM sizes) z ON z.doc_id = d.doc_id
"""
