"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` (host lower-cased) and the literal tokens that every match must hold as
whole tokens; a token may be several alternatives with ``|`` between them, of which every match holds one. Tokens
that aren't given are read off the pattern (``literal_tokens``). Each rule is indexed under one of its tokens (under
all alternatives of it), the one that the fewest URLs have (counted over all rows). The tokens of a URL fetch the candidate
rules, and only those run their regular expressions; rules whose patterns hold no whole token run on every URL.
Rows are judged where they lie: no shuffle but for the counts of the rules' own tokens, so a hot host costs nothing extra.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as patterns

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
MAX_RULES = 1_000_000  # rules are configuration; they are broadcast, about 300 bytes each


@dataclass(frozen=True)
class Rule:
    """name: what is returned as ``rule``; tier 0 rules win over tier 1, then the longest name, then the first by name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    tier: int = 0


def _is_edge(kind, value) -> bool:
    """Whether a parsed item is a literal that is no part of a token, or an end or boundary."""
    return (kind is kinds.LITERAL and value < 128 and re.fullmatch("[A-Za-z0-9_]", chr(value)) is None) or (kind is kinds.AT and value is not kinds.AT_NON_BOUNDARY)


def _ends_in_edge(items) -> bool:
    """Whether what a sequence matches, if anything, always ends in an edge."""
    if not len(items):
        return False
    kind, value = items[-1]
    return _ends_in_edge(value[3]) if kind is kinds.SUBPATTERN and not value[1] and not value[2] else _is_edge(kind, value)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every match of a pattern that is matched from the start holds whole.

    Runs of letters and digits count if the pattern has other literals, an end of the text or a word boundary on
    both sides; the start of the pattern is such an end. What repeats, branches or stands for several characters ends a run
    without one, unless it is left out or ends in one: a token that an optional group of that kind precedes still begins there.
    """
    found, run, open_ = [], "", True

    def sequence(items) -> None:
        nonlocal run, open_
        for kind, value in items:
            if kind is kinds.LITERAL and re.fullmatch("[A-Za-z0-9]", chr(value)):
                run += chr(value).lower()
            elif kind is kinds.SUBPATTERN and not value[1] and not value[2]:
                sequence(value[3])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
                least, _, items_ = value
                after = _ends_in_edge(items_) and (least > 0 or (open_ and not run))
                run, open_ = "", after
            else:
                edge = _is_edge(kind, value)
                if run and open_ and edge:
                    found.append(run)
                run, open_ = "", edge

    parsed = patterns.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    sequence(parsed)
    return tuple(dict.fromkeys(found))


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table(name, action, pattern, and where it has them tokens: array<string>, tier), in the order of name and pattern.

    Rows without a name, action or pattern are left out. Null tokens are read off the pattern.
    """
    has = table.columns
    rows = table.where("name is not null and action is not null and pattern is not null").select(
        "name", "action", "pattern", F.col("tokens") if "tokens" in has else F.lit(None).cast("array<string>").alias("tokens"), F.coalesce("tier", F.lit(0)).alias("tier") if "tier" in has else F.lit(0).alias("tier")
    )
    found = [(r.name, r.action, r.pattern, r.tokens, r.tier) for r in rows.orderBy("name", "pattern").limit(MAX_RULES + 1).toLocalIterator()]
    return tuple(Rule(n, a, p, tuple(t) if t is not None else literal_tokens(p), int(k)) for n, a, p, t, k in found)


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits the host and all its subdomains, if the path starts with ``path``."""
    tokens = re.findall(TOKEN, host)
    # the last token of the path is whole only if the path ends behind it
    tokens += re.findall(TOKEN, re.sub(r"[a-z0-9]+$", "", path.lower()))
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens))


#: fixed values: host rules of the query's contract
CONTRACT = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)

#: patterns of unwanted hosts and trackers, for URLs that no host rule fits
PATTERNS = (
    Rule("ads-track", "block", r"^[^/]*\bads?-track", ("ad|ads",), 1),
    Rule("spam-farm", "block", r"^[^/]*\bspam-farms?\.", ("spam",), 1),
    Rule("casino", "block", r"^[^/]*\bcasino(-[a-z0-9]+)?\.", ("casino",), 1),
    Rule("adult", "block", r"^[^/]*\badult-[a-z0-9]+\.", ("adult",), 1),
    Rule("cheap-pills", "block", r"^[^/]*\bcheap-pills?\.", ("cheap",), 1),
    Rule("free-bets", "block", r"^[^/]*\bfree-bets?\.", ("free",), 1),
)


def host_column(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url):
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(parts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many rows have each of the rules' tokens; at most one row a token comes back."""
    if not tokens:
        return {}
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), F.lit(1)))
    wanted = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = parts.select(F.explode(own).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Places of the rules by the token that fetches them; rules without any are under the empty text."""
    index: dict[str, list] = {}
    for place, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (sum(counts.get(x, 0) for x in t.split("|")), -len(t), t)) if rule.tokens else ""
        for t in rarest.split("|"):
            index.setdefault(t, []).append(place)
    return index


def filter_urls(df: DataFrame, rules: tuple[Rule, ...], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict, pattern, tried for every row of df.

    rule: the fitting tier-0 rule's name, else null; pattern: the fitting tier-1 rule's, where no
    tier-0 rule fits; verdict: the action of either, else ``default``; tried: how many
    regular expressions ran. Null, empty and malformed URLs have an empty host and path and get
    the default. Repeated rows and null keys are judged each; other columns of df are ignored; an empty table stays empty.
    """
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules to broadcast")
    parts = df.select(F.col(key).alias(key), host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    tokens = sorted({x for r in rules for t in r.tokens for x in t.split("|")})
    index = rule_index(tuple(rules), token_counts(parts, tokens))
    held = df.sparkSession.sparkContext.broadcast((tuple(rules), index))
    token = re.compile(TOKEN)

    def judge(batches):
        rules, index = held.value
        always = index.get("", [])
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            named, verdicts, patterns, tried = [], [], [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                subject = host + path
                places = {p for t in token.findall(subject.lower()) for p in index.get(t, ())}
                places.update(always)
                best = None
                for p in places:
                    if p not in compiled:
                        compiled[p] = re.compile(rules[p].pattern, re.S)
                    if compiled[p].match(subject):
                        order = rules[p].tier, -len(rules[p].name), rules[p].name, p
                        best = order if best is None else min(best, order)
                rule = rules[best[3]] if best else None
                named.append(rule.name if rule and rule.tier == 0 else None)
                patterns.append(rule.name if rule and rule.tier else None)
                verdicts.append(rule.action if rule else default)
                tried.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("host"), batch.column("path"), pa.array(named, pa.string()), pa.array(verdicts, pa.string()), pa.array(patterns, pa.string()), pa.array(tried, pa.int32())],
                [key, "host", "path", "rule", "verdict", "pattern", "tried"],
            )

    kind = dict(parts.dtypes)[key]
    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string, pattern string, tried int")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, CONTRACT + PATTERNS).drop("tried")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
m AS (SELECT p.*, rule, action, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(host || path, '^[^/]*\bads?-track') THEN 'ads-track'
  WHEN regexp_matches(host || path, '^[^/]*\bspam-farms?\.') THEN 'spam-farm'
  WHEN regexp_matches(host || path, '^[^/]*\bcheap-pills?\.') THEN 'cheap-pills'
  WHEN regexp_matches(host || path, '^[^/]*\bfree-bets?\.') THEN 'free-bets'
  WHEN regexp_matches(host || path, '^[^/]*\bcasino(-[a-z0-9]+)?\.') THEN 'casino'
  WHEN regexp_matches(host || path, '^[^/]*\badult-[a-z0-9]+\.') THEN 'adult' END AS pattern
  FROM p LEFT JOIN b USING (page_id))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM m
"""
