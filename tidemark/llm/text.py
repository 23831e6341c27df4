"""Vectorised text kernels for use inside Arrow map functions.

A batch of texts is handled as one byte array with offsets, never as Python strings.
Letters A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D
(so whole UTF-8 sequences stay inside words); a null text counts as empty.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20
SMALL = 1 << 18  # for tasks that stand beside others of a pipeline: what numpy makes of a byte takes some dozens

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64 arrays (shift-multiply, public domain splitmix constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LANE = mix64(np.arange(1, 65, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = n + (n >> 1) if n <= CHUNK + (CHUNK >> 1) else n
        up = np.full(size, _R, U)
        down = np.full(size, _RINV, U)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 4 * CHUNK:
            return made
        _powers[:] = made
    return _powers[0], _powers[1]


def arrow_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``chunk`` bytes; a longer text is a piece of its own."""
    data, offsets = arrow_bytes(col)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and len+1 pointers from texts into them."""
    n = len(low)
    word = ~SPACE[low]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial."""
    up, down = _pow(len(low) + 1)
    total = np.zeros(len(low) + 1, U)
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and pointers from texts into them."""
    low = LOWER[data]
    starts, ends, ptr = word_spans(low, offsets)
    return span_hashes(low, starts, ends), ptr


def shingles(words: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles with pointers; a text with fewer words has its whole sequence as one."""
    count = np.diff(ptr)
    total = len(words)
    made = np.zeros(total, U)
    padded = np.concatenate([words, np.zeros(n, U)])
    for k in range(n):
        made += padded[k : k + total] * _LANE[k]
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(ptr), np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(ptr[:-1] - out[:-1], size)
    h = made[at]
    length = np.full(len(h), n, U)
    for row in np.flatnonzero((count > 0) & (count < n)):
        a, c = ptr[row], count[row]
        h[out[row]] = (words[a : a + c] * _LANE[:c]).sum(dtype=U)
        length[out[row]] = c
    return mix64(h ^ (length << U(56))), out


def distinct(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    h = h.copy()
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    heads = ptr[:-1][ptr[:-1] < ptr[1:]]
    keep[heads] = True
    seen = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=seen[1:])
    return h[keep], seen[ptr]


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each text's values (wrapping for uint64); 0 for none."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def lists(values: pa.Array, ptr: np.ndarray) -> pa.ListArray:
    """One list for each text."""
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), values)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(c := ctypes.CDLL(libc), "malloc_trim"):
        c.malloc_trim(0)


def tidied(made):
    """A task's table or batches; freed memory goes back to the system behind it, as workers live on beside their executor's other memory."""
    if isinstance(made, pa.Table):
        _release()
        return made
    return _tidied(made)


def _tidied(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        _release()
