"""Dealing of sorted 64-bit hashes, with narrow columns beside them, to ranges of the hash space.

A chunk's hashes are cut at the ranges' ends, and each piece is one row (a cell) of packed arrays: far less to shuffle
than a row for each hash. A chunk is dealt to 2^FAN ranges at most; if more are needed, the cells of a range are
gathered in packs, sorted and dealt again by their next bits, so that the number of cells stays in proportion to the
number of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tidied

U = np.uint64
_CODEC = "zstd"
PACK_CELLS = 1024
KINDS = {"value": U, "node": U, "slot": np.uint8, "weight": np.uint32, "core": U, "tune": U}


def pack(a: np.ndarray) -> bytes:
    """An array of integers, its bytes by significance, compressed; the reader knows the length and kind."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), codec=_CODEC, asbytes=True) if len(a) else b""


def unpack_one(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, n * width, codec=_CODEC), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def cells(value: np.ndarray, g: int, bits: int, beside: dict[str, np.ndarray], width: int = 64, p: int = 0, skip: int = 0, **constant: int):
    """A batch of cells of sorted values that are cut at the ``bits`` bits behind their first ``skip`` ones.

    width: bits that values have (the low ones are 0). p: the range that the values lie in so far. constant: columns
    of one int.
    """
    if not len(value):
        return
    place = (value << U(skip) >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
    heads = np.flatnonzero(np.diff(place, prepend=-1))
    edges = np.append(heads, len(value)).tolist()
    short = value >> U(64 - width)
    columns = {"p": (p << bits) + place[heads], "g": np.full(len(heads), g), "n": np.diff(edges)}
    data = {"value": [], **{k: [] for k in beside}}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data["value"].append(pack(np.diff(short[a:b], prepend=U(0))))
        for k, x in beside.items():
            data[k].append(pack(x[a:b]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(columns["p"].astype(np.int32)), pa.array(columns["g"]), pa.array(columns["n"].astype(np.int32)), *(pa.array(x, pa.binary()) for x in data.values()),
            *(pa.array(np.full(len(heads), x, np.int32)) for x in constant.values()),
        ],
        ["p", "g", "n", *data, *constant],
    )


def unpack(table: pa.Table, name: str, width: int = 64) -> np.ndarray:
    """A packed column of all cells of a table, one after the other; values come without the bits below ``width``."""
    n = table.column("n").to_pylist()
    parts = [unpack_one(b.as_py(), k, KINDS[name]) for b, k in zip(table.column(name), n, strict=True)]
    if name == "value":
        parts = [np.cumsum(x, dtype=U) for x in parts]
    return np.concatenate(parts) if parts else np.zeros(0, KINDS[name])


def levels_of(bits: int, fan: int) -> list[int]:
    """Bits of the ranges, level by level."""
    out = [min(bits, fan)]
    while sum(out) < bits:
        out.append(min(bits - sum(out), fan))
    return out


def _again(beside: list[str], bits: int, skip: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        value = unpack(t, "value") << U(64 - width)
        order = np.argsort(value, kind="stable")
        columns = {k: unpack(t, k)[order] for k in beside}
        return tidied(pa.Table.from_batches(list(cells(value[order], t.column("g")[0].as_py(), bits, columns, width, t.column("p")[0].as_py(), skip))))

    return run


def deal(dealt: DataFrame, levels: list[int], beside: list[str], chunks: int, width: int = 64, most: int = 1 << 30) -> DataFrame:
    """Cells that are dealt by the first of ``levels`` bits, dealt again by the others; ranges from ``most`` on stay.

    chunks: about how many there are; those of a range are gathered in packs of PACK_CELLS.
    """
    skip, packs = levels[0], -(-chunks // PACK_CELLS) + 1
    for bits in levels[1:]:
        fixed = dealt.where(F.col("p") >= most)
        moved = dealt.where(F.col("p") < most)
        moved = moved.groupBy("p", F.pmod(F.xxhash64("g"), F.lit(packs)).alias("pack")).applyInArrow(_again(beside, bits, skip, width), dealt.schema)
        dealt = moved.unionByName(fixed)
        skip += bits
    return dealt
