"""Paths as Column expressions: normal form, relative to a repository, and inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a path in prose looks like, and what may trail it
PROSE_PATH = r"(?<![\w~:/])~?/(?!/)\S+"
PROSE_TAIL = r"[.,:;!?)\]}>'\"`]*$"


def normal(path: Column) -> Column:
    """An absolute path without empty, '.' and '..' parts; '..' above the root is left out."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", up(s)).otherwise(F.array_append(s, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def relativize(path: Column, repo: Column, home: Column, level: int = 1) -> Column:
    """A path relative to the repository, ``.`` for its root, or ``<outside>/`` and 8 hex digits of its hash.

    Null for an empty path, and for any path at level 0. A relative path is taken as one below the
    repository; without a repository it stays as it is.
    """
    if level <= 0:
        return F.lit(None).cast("string")
    text = F.trim(path)
    full = F.when(text == "~", home).when(text.startswith("~/"), F.concat(home, F.substring(text, 2, 1 << 30))).otherwise(text)
    absolute = full.startswith("/")
    both = F.struct(normal(F.when(absolute, full).otherwise(F.concat(repo, F.lit("/"), full))).alias("path"), normal(repo).alias("root"))

    def named_of(x: Column) -> Column:
        path, root = x["path"], x["root"]
        below = F.when(root == "/", F.substring(path, 2, 1 << 30)).when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.lit(1 << 30)))
        far = F.concat(F.lit("<outside>/"), F.substring(F.sha2(path, 256), 1, 8))
        return F.struct(F.when(path == root, F.lit(".")).otherwise(F.coalesce(below, far)).alias("named"), far.alias("outside"))

    # the normal forms are bound once, so that they don't repeat in what is made of them
    made = F.transform(F.array(both), named_of)[0]
    named, outside = made["named"], made["outside"]
    return F.when(text == "", None).when(~absolute & repo.isNull(), full).when(repo.isNull(), outside).otherwise(named)


def prose(text: Column, repo: Column, home: Column, level: int = 1) -> Column:
    """Free text with each absolute path in it rewritten; ``<path>`` at level 0."""
    between = F.split(text, PROSE_PATH)
    runs = F.regexp_extract_all(text, F.lit(f"({PROSE_PATH})"), F.lit(1))

    def rewritten(run: Column) -> Column:
        bare = F.regexp_replace(run, PROSE_TAIL, "")
        tail = F.substring(run, F.length(bare) + 1, F.lit(1 << 30))
        return F.concat(F.coalesce(relativize(bare, repo, home, level), F.lit("<path>")), tail)

    return F.array_join(F.zip_with(between, F.transform(runs, rewritten), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
