"""A tree of line files as a data source: ``spark.read.format("line_tree")``, with parts of about equal bytes and links kept inside the root.

The root has to be a folder that driver and executors see under the same path. Files are listed when a query is planned;
each part reads its own stretches of files, line by line. A line belongs to the stretch in which it begins.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 64 << 20
SCHEMA = "path string, at long, value string, size long, why string"


@dataclass
class Stretches(InputPartition):
    """(path below the root, first byte, end, bytes of the file, why it isn't read) of each stretch."""

    files: list[tuple[str, int, int, int, str | None]]


def listed(root: str, pattern: str) -> Iterator[tuple[str, int, str | None]]:
    """(path below the root, bytes, why it can't be read) of each matching file, in the order of paths.

    Links are followed while they stay below the root; what leaves it is ``outside``, a folder that was seen is left out, and what is gone or may
    not be read is ``unreadable``.
    """
    real = os.path.realpath(root)
    inside = lambda p: p == real or p.startswith(real.rstrip("/") + "/")
    seen: set[str] = set()
    folders, found = [real], []
    while folders:
        folder = folders.pop()
        target = os.path.realpath(folder)
        if target in seen:
            continue
        seen.add(target)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            found.append((os.path.relpath(folder, real), 0, "unreadable"))
            continue
        for e in entries:
            target, name = os.path.realpath(e.path), os.path.relpath(e.path, real)
            if not inside(target):
                found.append((name, 0, "outside"))
            elif e.is_dir():
                folders.append(e.path)
            elif fnmatch.fnmatchcase(e.name, pattern):
                try:
                    readable = os.access(e.path, os.R_OK)
                    found.append((name, os.stat(e.path).st_size if readable else 0, None if readable else "unreadable"))
                except OSError:
                    found.append((name, 0, "unreadable"))
    yield from sorted(found)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern = options.get("path") or options["root"], options.get("pattern", "*.jsonl")
        self.part = int(options.get("partbytes") or options.get("partBytes") or PART_BYTES)

    def partitions(self) -> list[Stretches]:
        """Small files together, large ones in several parts."""
        parts, now, held = [], [], 0
        for name, size, why in listed(self.root, self.pattern):
            start = 0
            while True:
                end = min(size, start + self.part - held)
                now.append((name, start, end, size, why))
                held += end - start
                if held >= self.part or len(now) >= 1000:
                    parts.append(Stretches(now))
                    now, held = [], 0
                start = end
                if start >= size:
                    break
        return parts + ([Stretches(now)] if now else []) or [Stretches([])]

    def read(self, partition: Stretches) -> Iterator[tuple]:
        for name, start, end, size, why in partition.files:
            if why is None:
                try:
                    yield from self._lines(name, start, end, size)
                except OSError:
                    why = "unreadable"
            if start == 0 and (why is not None or size == 0):
                yield name, None, None, size, why

    def _lines(self, name: str, start: int, end: int, size: int) -> Iterator[tuple]:
        with open(os.path.join(os.path.realpath(self.root), name), "rb") as f:
            if start:
                f.seek(start - 1)
                f.readline()  # the line that began before; nothing but a line end, if this stretch begins with a line
            at = f.tell()
            while at < end:
                line = f.readline()
                if not line:
                    return
                yield name, at, line.rstrip(b"\n").decode("utf-8", "replace"), size, None
                at += len(line)


class LineTree(DataSource):
    """Lines of a folder's files with the path below it, the byte at which each begins, and its file's size.

    Options: path or root, pattern (of file names, case-sensitive), partBytes. Files without lines, and those that can't be read, are one row without
    a value; why says what keeps a file from being read.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(LineTree)
    return spark.read.format("line_tree").option("pattern", pattern).option("partBytes", part_bytes).load(root)


def survey(lines: DataFrame) -> DataFrame:
    """One row a file: bytes, lines, bad lines, first and last time, session and folder of work, and why it isn't read."""
    v = F.try_parse_json("value")
    field = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    stamp = F.try_to_timestamp(field("$.timestamp")).cast("timestamp_ntz")
    rows = lines.select(
        "path", "at", "size", "why", F.col("value").isNotNull().alias("is_line"), (F.col("value").isNotNull() & v.isNull()).alias("bad"), stamp.alias("stamp"), field("$.sessionId", "$.session_id", "$.payload.id").alias("session"), field("$.cwd", "$.payload.cwd").alias("cwd")
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return rows.groupBy("path").agg(
        F.max("size").alias("bytes"), F.count_if("is_line").alias("lines"), F.count_if("bad").alias("bad"), F.min("stamp").alias("first"), F.max("stamp").alias("last"), first("session").alias("session"), first("cwd").alias("cwd"), F.max("why").alias("why")
    )


def since(surveyed: DataFrame, day: str | None = None, project: str | None = None) -> DataFrame:
    """Files whose first time is on or behind a day, and whose first folder of work is the project or lies in it; files without a time aren't kept by a day."""
    rows = surveyed.where(F.col("why").isNull())
    if day is not None:
        rows = rows.where(F.col("first") >= F.to_timestamp_ntz(F.lit(f"{day} 00:00:00")))
    if project is not None:
        rows = rows.where((F.col("cwd") == project) | F.col("cwd").startswith(project.rstrip("/") + "/"))
    return rows
