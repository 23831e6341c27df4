"""Scalar functions as Column expressions: cleaning, ids, dates, versions, paths and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: secrets are matched by these patterns, in this order; of the last only the value goes
KEY_HEADER = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY[ A-Z0-9]{0,20}-----"
KEY_FOOTER = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY[ A-Z0-9]{0,20}-----"
SECRETS = (
    KEY_HEADER + r"[\s\S]*?" + KEY_FOOTER,
    KEY_HEADER,
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{16,}",
    r"\bsk-[A-Za-z0-9_-]{16,}",
    r"\bgh[po]_[A-Za-z0-9]{16,}\b",
    r"\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
)
ASSIGNED = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_.-]{0,63}=)([A-Za-z0-9+/=_-]{32,})"
# fixed values: bounds of stored strings
MAX_STRING, MAX_ENUM, MAX_ID, MAX_ITEMS, MAX_DEPTH, MAX_PAYLOAD = 512, 64, 128, 256, 6, 8 * 1024
MARK = "<redacted>"


#: every match of a pattern holds one of these
HINTS = ("-----BEGIN ", "AKIA", "sk-", "gho_", "ghp_", "Bearer", "=")


def scrub(text: Column) -> Column:
    """text with every secret replaced by MARK; texts without any hint of one don't run the patterns."""
    hint = text.contains(HINTS[0])
    for h in HINTS[1:]:
        hint = hint | text.contains(h)
    clean = text
    for pattern in SECRETS:
        clean = F.regexp_replace(clean, pattern, MARK)
    return F.when(hint, F.regexp_replace(clean, ASSIGNED, "$1" + MARK)).otherwise(text)


def secret_count(text: Column) -> Column:
    """How many marks scrubbing puts in that weren't there."""
    marks = lambda c: F.regexp_count(c, F.lit(MARK))
    return marks(scrub(text)) - marks(text)


def numbered(scrubbed: Column) -> Column:
    """Marks as <redacted:1>, <redacted:2>, ... in the order of the text."""
    parts = F.split(scrubbed, MARK)
    tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x, i: F.concat(F.lit("<redacted:"), (i + 1).cast("string"), F.lit(">"), x))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def bounded(text: Column, limit: int = MAX_STRING) -> Column:
    return F.substring(text, 1, limit)


def snake(name: Column) -> Column:
    """camelCase and CamelCase as snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def iso_week(column: str) -> Column:
    """2024-W05: the ISO week and its year."""
    return F.format_string("%04d-W%02d", F.expr(f"extract(YEAROFWEEK from {column})"), F.weekofyear(column))


def version_numbers(version: Column) -> Column:
    """The numbers of a dotted version, for sorting; null if a part is no number."""
    parts = F.split(version, r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


def major(version: Column) -> Column:
    """The first two parts of a version."""
    return F.substring_index(version, ".", 2)


def canonical_json(entries: Column) -> Column:
    """A map as compact JSON with sorted keys, so that equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def exit_code(text: Column) -> Column:
    """N of a text that starts with 'Exit code N'."""
    return F.regexp_extract(text, r"^Exit code (-?\d{1,9})", 1).try_cast("int")


def ms_between(start: str, end: str) -> Column:
    """Milliseconds from start to end, rounded half to even; null for a negative span."""
    ms = F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / 1000.0
    return F.when(ms >= 0, F.bround(ms).cast("long"))


def hashed_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 24))


def under(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies in that folder."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(F.split(path, "/"), lambda p: p.isin("test", "tests", "__tests__")) | name.rlike(r"^test_|_test\.|\.test\.|\.spec\.")


def slug(url: Column) -> Column:
    """owner/name of a repository's address in either of its two forms."""
    return F.nullif(F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1), F.lit(""))


def fresh_tokens(total: Column, cached: Column) -> Column:
    return F.when(total >= cached, total - cached)


def known_status(word: Column) -> Column:
    """1 for a word that says passed, 0 for one that says failed, null for any other."""
    w = F.lower(F.trim(word))
    return F.when(w.isin("pass", "passed", "success", "ok"), 1).when(w.isin("fail", "failed", "failure", "error"), 0)


def allowed_only(payload: Column, allowed: Sequence[str]) -> Column:
    return F.map_filter(payload, lambda k, _: k.isin(*allowed))


def dropped_keys(payload: Column, allowed: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(payload), F.lit(list(allowed))))


def bound_payload(payload: Column, limit: int = MAX_PAYLOAD) -> Column:
    """The map without its widest entries (ties: the later key), as few as make the rest fit the limit."""
    width = lambda e: F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(4)) + 6
    sized = F.array_sort(F.transform(F.map_entries(payload), lambda e: F.struct(width(e).alias("w"), e["key"].alias("key"), e["value"].alias("value"))))
    kept = F.aggregate(
        sized, F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<key:string,value:string>>)").alias("out")),
        lambda s, e: F.when(s["used"] + e["w"] <= limit, F.struct((s["used"] + e["w"]).alias("used"), F.array_append(s["out"], F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("out"))).otherwise(F.struct(F.lit(limit + 1).alias("used"), s["out"].alias("out"))),
        lambda s: s["out"],
    )
    return F.map_from_entries(kept)
