"""Git history staged as text: numstat and unified diffs unnested, and line overlap between commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LINE = 3  # fixed value: lines of so many characters or fewer say nothing


def numstat(commits: DataFrame, text: str, *keep: str) -> DataFrame:
    """(path, added, removed) of each line of a numstat text; '-' counts of binary files are unknown."""
    line = commits.select(*keep, F.explode(F.filter(F.split(text, "\n"), lambda x: x != "")).alias("line"))
    parts = F.split("line", "\t", 3)
    return line.where(F.size(parts) == 3).select(*keep, parts[2].alias("path"), parts[0].try_cast("int").alias("added"), parts[1].try_cast("int").alias("removed"))


#: a record of a numstat text with NULs: counts and a path, or counts, an old and a new path
RECORD = r"(?:^|(?<=\x00))[0-9-]+\t[0-9-]+\t(?:[^\x00]++(?:\x00|$)|\x00[^\x00]++\x00[^\x00]++(?:\x00|$))"


def numstat_z(commits: DataFrame, text: str, *keep: str) -> DataFrame:
    """(path, old_path, added, removed) of a numstat text with NUL separators: a rename's record has an empty path and two more fields.

    An ended record is three tab-separated fields; ``added TAB removed TAB NUL old NUL new NUL`` is a rename. Records are
    taken from left to right, in time that grows with the text; a rename that is cut off at the end is left out.
    """
    record = F.explode(F.regexp_extract_all(text, F.lit(RECORD), F.lit(0))).alias("record")
    parts = F.split("record", "\x00")
    counts = F.split(parts[0], "\t", 3)
    renamed = counts[2] == ""
    return commits.select(*keep, record).select(
        *keep, F.when(renamed, parts[2]).otherwise(counts[2]).alias("path"), F.when(renamed, parts[1]).alias("old_path"), counts[0].try_cast("int").alias("added"), counts[1].try_cast("int").alias("removed")
    )


def totals(changes: DataFrame, *key: str) -> DataFrame:
    """Sums that are null if any file of a commit has no counts."""
    known = F.bool_and(F.col("added").isNotNull() & F.col("removed").isNotNull())
    return changes.groupBy(*key).agg(F.count("*").alias("files"), F.when(known, F.sum("added")).alias("added"), F.when(known, F.sum("removed")).alias("removed"))


def diff_lines(commits: DataFrame, text: str, *keep: str) -> DataFrame:
    """(path, side, line) of a unified diff's added and removed lines.

    A diff is cut at its hunks' headers, which no line inside a hunk looks like. A header says how many old and new lines
    follow; what is behind them may be headers of the next file, so lines that look like file headers are only taken for them
    there. A fold over a hunk's lines counts, and one over the hunks carries the files' names.
    """
    stated = lambda head, sign: F.coalesce(F.nullif(F.regexp_extract(head, rf"^@@ -\S+ \+[0-9]+(?:,([0-9]+))? @@" if sign == "+" else r"^@@ -[0-9]+(?:,([0-9]+))? ", 1), F.lit("")).try_cast("int"), F.lit(1))
    named = lambda lines, sign, lead: F.regexp_replace(F.substring(F.try_element_at(F.filter(lines, lambda x: x.startswith(f"{sign} ")), F.lit(-1)), 5, 1 << 30), f"^{lead}/", "")

    def count(s, x):
        """Lines that are left of both sides, and how many there were before none is."""
        inside = (s["old"] > 0) | (s["new"] > 0)
        old = F.when(x.startswith("+") | x.startswith("\\"), s["old"]).otherwise(s["old"] - 1)
        new = F.when(x.startswith("-") | x.startswith("\\"), s["new"]).otherwise(s["new"] - 1)
        return F.when(inside | (x.startswith("\\") & ~s["over"]), F.struct(old.alias("old"), new.alias("new"), (s["lines"] + 1).alias("lines"), F.lit(False).alias("over"))).otherwise(
            F.struct(s["old"].alias("old"), s["new"].alias("new"), s["lines"].alias("lines"), F.lit(True).alias("over"))
        )

    def cut(lines):
        """A hunk's lines, and those behind it."""
        body = F.slice(lines, F.lit(2), F.size(lines))
        start = F.struct(stated(lines[0], "-").alias("old"), stated(lines[0], "+").alias("new"), F.lit(0).alias("lines"), F.lit(False).alias("over"))
        n = F.when(lines[0].startswith("@@ "), F.aggregate(body, start, count, lambda s: s["lines"])).otherwise(F.lit(0))
        behind = F.when(lines[0].startswith("@@ "), body).otherwise(lines)
        return F.struct(F.slice(body, F.lit(1), n).alias("inside"), F.slice(behind, n + 1, F.size(lines)).alias("behind"))

    pieces = F.transform(F.split(text, "\n(?=@@ )"), lambda p: cut(F.split(p, "\n")))
    told = F.transform(pieces, lambda p: F.struct(p["inside"].alias("inside"), named(p["behind"], "---", "a").alias("old"), named(p["behind"], "+++", "b").alias("new")))
    hunk = "array<struct<old:string,new:string,inside:array<string>>>"

    def carry(s, p):
        at = F.array(F.struct(s["old"].alias("old"), s["new"].alias("new"), p["inside"].alias("inside"))).cast(hunk)
        return F.struct(F.coalesce(p["old"], s["old"]).alias("old"), F.coalesce(p["new"], s["new"]).alias("new"), F.when(F.size(p["inside"]) > 0, F.concat(s["out"], at)).otherwise(s["out"]).alias("out"))

    unknown = F.lit(None).cast("string")
    hunks = F.aggregate(told, F.struct(unknown.alias("old"), unknown.alias("new"), F.expr(f"cast(array() as {hunk})").alias("out")), carry, lambda s: s["out"])
    each = commits.select(*keep, F.explode(hunks).alias("h")).select(*keep, "h.old", "h.new", F.explode("h.inside").alias("x"))
    added = F.col("x").startswith("+")
    rows = each.where(added | F.col("x").startswith("-")).select(
        *keep, F.when(added, F.col("new")).otherwise(F.col("old")).alias("path"), F.when(added, "added").otherwise("removed").alias("side"), F.substring("x", 2, 1 << 30).alias("line")
    )
    return rows.where((F.length(F.trim("line")) > MIN_LINE) & (F.col("path") != "/dev/null"))


def reworked(lines: DataFrame, repo: str, position: str, ahead: int = 3) -> DataFrame:
    """Commits whose added lines one of the next ``ahead`` commits removes, and the first that does.

    Positions are whole numbers: an added line is looked for at each of the next ones by an equi-join, so a line that is
    common in a repository doesn't meet all its other places.
    """
    near = F.explode(F.sequence(F.col(position) + 1, F.col(position) + ahead)).alias("later")
    a = lines.where("side = 'added'").select(repo, "path", "line", position).distinct().select("*", near)
    b = lines.where("side = 'removed'").select(repo, "path", "line", F.col(position).alias("later")).distinct()
    return a.join(b, [repo, "path", "line", "later"]).groupBy(repo, position).agg(F.min("later").alias("by"))
