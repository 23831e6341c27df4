"""Shell commands in normal form: categories, scope and whether an exit status is masked.

A normal form is words joined by spaces with && || ; | between segments. Everything here is Column
expressions: ``normal_form`` makes it from a raw line by a lexer that is a fold over tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories by leading words (the longest match wins), runner words, and the order in which
# a chain's verification categories win
RULES = {
    "pytest": "test", "vitest": "test", "jest": "test", "go test": "test", "cargo test": "test", "npm test": "test",
    "mypy": "typecheck", "pyright": "typecheck", "tsc": "typecheck", "ty": "typecheck",
    "ruff check": "lint", "eslint": "lint", "flake8": "lint", "pylint": "lint",
    "ruff format": "format", "black": "format", "prettier": "format",
    "uv build": "build", "npm run build": "build", "make": "build", "cargo build": "build", "docker build": "build",
    "hyperfine": "benchmark", "gitleaks": "security_scan", "bandit": "security_scan", "uv audit": "security_scan", "npm audit": "security_scan",
    "uv sync": "package_op", "uv add": "package_op", "uv lock": "package_op", "uv pip": "package_op", "pip": "package_op", "pip3": "package_op", "npm install": "package_op", "npm ci": "package_op",
    "git": "git", "kill": "process_mgmt", "pkill": "process_mgmt", "ps": "process_mgmt", "sleep": "process_mgmt", "wait": "process_mgmt",
    "ls": "shell", "cat": "shell", "sed": "shell", "grep": "shell", "rg": "shell", "find": "shell", "head": "shell", "tail": "shell", "echo": "shell", "wc": "shell", "which": "shell",
}
RUNNERS = ("uv run", "uvx", "npx", "poetry run", "pdm run", "hatch run", "python", "python3")
VERIFICATION = ("test", "benchmark", "typecheck", "lint", "format", "build", "security_scan")
SEPARATORS = ("&&", "||", ";", "|")


def segments(command: Column) -> Column:
    return F.transform(F.split(command, r"\s+(?:&&|\|\||;|\|)\s+"), F.trim)


def _words(segment: Column) -> Column:
    """The segment's words without leading assignments and runners, and without flags."""
    bare = F.regexp_replace(segment, r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s*)+", "")
    runner = "|".join(re.escape(r) for r in RUNNERS)
    return F.filter(F.split(F.regexp_replace(bare, rf"^(?:(?:{runner})\s+)+", ""), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))


def segment_category(segment: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    words = _words(segment)
    lead = lambda n: F.try_element_at(table, F.array_join(F.slice(words, F.lit(1), F.lit(n)), " "))
    found = F.coalesce(lead(3), lead(2), lead(1), F.lit("unknown"))
    return F.when((found == "test") & segment.rlike(r"(^|\s)--benchmark"), "benchmark").otherwise(found)


def categories(command: Column) -> Column:
    return F.array_distinct(F.transform(segments(command), segment_category))


def category(command: Column) -> Column:
    """The chain's first verification category by priority, else its first known one."""
    found = F.transform(segments(command), segment_category)
    first = F.filter(F.lit(list(VERIFICATION)), lambda v: F.array_contains(found, v))
    return F.coalesce(F.try_element_at(first, F.lit(1)), F.try_element_at(F.filter(found, lambda c: c != "unknown"), F.lit(1)), F.lit("unknown"))


def exit_masked(command: Column) -> Column:
    """Whether an operator other than && stands behind the first verification segment, so the status may be another's."""
    ops = F.regexp_extract_all(command, F.lit(r"\s(&&|\|\||;|\|)\s"), F.lit(1))
    checks = F.transform(segments(command), lambda s: segment_category(s).isin(*VERIFICATION))
    at = F.array_position(checks, True).cast("int")
    return (at > 0) & F.exists(F.slice(ops, F.greatest(at, F.lit(1)), F.greatest(F.size(ops), F.lit(0))), lambda o: o != "&&")


def scope(command: Column) -> Column:
    """targeted if a test command names a path or a -k expression, else full."""
    tests = F.filter(segments(command), lambda s: segment_category(s) == "test")
    narrow = F.exists(tests, lambda s: s.rlike(r"\s(-k\s|\S*/\S*|\S+::\S+|\S+\.py\b)"))
    return F.when(F.size(tests) > 0, F.when(narrow, "targeted").otherwise("full"))


# the lexer: a comment, a run of operator signs, a line end, or a word of quoted and bare parts; loops are possessive, so long texts need no deep stack
COMMENT = r"(?<![^\s;|&()])#[^\n]*+"
QUOTED = r"'[^']*+'|\"(?:[^\"\\]++|\\[\s\S])*+\""
WORD = rf"(?:{QUOTED}|\\[\s\S]|[^\s\"'\\|&;<>()]++)++"
TOKEN = rf"{COMMENT}|[|&;<>()]++|\n|{WORD}"
HEREDOC = r"(?<!<)<<(?!<)-?[ \t]*(?:'[^'\n]*'|\"[^\"\n]*\"|[A-Za-z_][A-Za-z0-9_]*)"
UNCLOSED = r"^(?:'[^']*+|\"(?:[^\"\\]++|\\[\s\S])*+)$"
# fixed values: shapes of words that stay, how many of them, and the bound of a normal form
ASSIGNMENT, BARE, FLAG = r"^[A-Za-z_][A-Za-z0-9_]*=", r"^[a-z][a-z0-9_.-]{0,31}$", r"^--?[A-Za-z0-9][A-Za-z0-9_.:+-]{0,31}$"
BARE_WORDS, MAX_COMMAND = 2, 512
PARTS = ("|", "||", "&&", ";", "&")
OPEN = ("|", "||", "&&", ";", "&", "(")  # the line end behind these ends nothing


def without_bodies(line: Column) -> Column:
    """A command's lines without the bodies of its heredocs, each of which is one ``_`` behind its tag.

    A fold over the lines with a queue of open heredocs and the quote that is open, if any: a tag in quotes or in a
    comment opens none, and a body's quotes open nothing.
    """
    spans = rf"{COMMENT}|{HEREDOC}|{QUOTED}|\\.|'[^']*+$|\"(?:[^\"\\]++|\\[\s\S])*+$"

    def step(s: Column, x: Column) -> Column:
        found = F.regexp_extract_all(F.concat(s["quote"], x), F.lit(f"({spans})"), F.lit(1))
        tags = F.filter(found, lambda m: m.startswith("<<"))
        last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
        quote = F.when(last.rlike(UNCLOSED), F.substring(last, 1, 1)).otherwise("")
        told = F.regexp_replace(x, rf"({HEREDOC})", "$1 _")
        kept = F.struct(F.transform(tags, lambda t: F.regexp_replace(t, r"^<<|[ \t'\"]", "")).alias("queue"), quote.alias("quote"), F.array_append(s["out"], F.when(F.size(tags) > 0, told).otherwise(x)).alias("out"))
        tag = F.coalesce(F.try_element_at(s["queue"], F.lit(1)), F.lit(""))
        ends = F.when(tag.startswith("-"), F.regexp_replace(x, r"^\t+", "") == F.substring(tag, 2, 1 << 30)).otherwise(x == tag)
        body = F.struct(F.when(ends, F.slice(s["queue"], F.lit(2), F.size(s["queue"]))).otherwise(s["queue"]).alias("queue"), s["quote"].alias("quote"), s["out"].alias("out"))
        return F.when(F.size(s["queue"]) > 0, body).otherwise(kept)

    none = F.expr("cast(array() as array<string>)")
    folded = F.aggregate(F.split(line, "\n", -1), F.struct(none.alias("queue"), F.lit("").alias("quote"), none.alias("out")), step, lambda s: F.array_join(s["out"], "\n"))
    return F.when(line.rlike("<<"), folded).otherwise(line)


def _assigned(word: Column) -> Column:
    return F.concat(F.substring_index(word, "=", 1), F.lit("="))


def _base(word: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(word, "([^/]+)/*$", 1), F.lit("")), word)


def _fallback(text: Column, level: int) -> Column:
    """What is sure of a line with an open quote: its command, bare words behind it, and ``_`` for the rest."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    ahead = F.size(words) - F.size(F.regexp_extract_all(F.regexp_replace(F.array_join(words, " "), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S* ?)++", ""), F.lit(r"(\S+)"), F.lit(1)))
    head = _base(F.coalesce(F.try_element_at(words, ahead + 1), F.lit("")))
    rest = F.slice(words, ahead + 2, F.size(words))
    bare = F.when(~F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")).rlike(BARE), 0).when(~F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit("")).rlike(BARE), 1).otherwise(2)
    if level <= 0:
        return head
    parts = F.concat(F.transform(F.slice(words, F.lit(1), ahead), _assigned), F.array(head), F.slice(rest, F.lit(1), bare), F.when(F.size(rest) > bare, F.array(F.lit("_"))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def normal_form(line: Column, repo: Column | None = None, home: Column | None = None, level: int = 1) -> Column:
    """A struct of ``text``, a raw line's normal form, ``redacted``, whether a secret was taken from it, and ``cut``, whether it reached the bound.

    A command's name stays without its folder, assignments without their values, flags without theirs; of bare words the first two, not
    counting those of a runner; paths stay relative to ``repo`` (see ``paths.relativize``), all else is ``_``. Line ends part
    commands but in quotes and behind an operator; heredoc bodies are left out. At level 0 only names of commands stay.
    """
    from .paths import relativize
    from .scalars import MARK, scrub

    unknown = F.lit(None).cast("string")
    repo, home = repo if repo is not None else unknown, home if home is not None else unknown
    runner = "|".join(re.escape(r) for r in RUNNERS)
    none = F.expr("cast(array() as array<string>)")

    def state(out: Column, started: Column, chain: Column, left: Column) -> Column:
        return F.struct(out.alias("out"), started.alias("started"), chain.alias("chain"), left.alias("left"))

    def step(s: Column, t: Column) -> Column:
        add = lambda x: F.array_append(s["out"], x)
        last = F.coalesce(F.try_element_at(s["out"], F.lit(-1)), F.lit(";"))
        fresh = lambda out: state(out, F.lit(False), F.lit(""), F.lit(BARE_WORDS))
        word = F.regexp_replace(t, rf"'([^']*+)'|\"((?:[^\"\\]++|\\[\s\S])*+)\"|\\([\s\S])", "$1$2$3")
        chain = F.concat_ws(" ", s["chain"], word)
        free = (s["chain"] != "") & chain.rlike(rf"^(?:(?:{runner}) )*(?:{runner})$")
        same = lambda x: state(add(x), s["started"], F.lit(""), s["left"])
        flag = F.substring_index(word, "=", 1)
        way = relativize(word, repo, home, level)
        way = F.when(way.isNull() | way.rlike(r"\s"), "_").otherwise(F.when(word.endswith("/") & ~way.endswith("/"), F.concat(way, F.lit("/"))).otherwise(way))
        assigned = word.rlike(ASSIGNMENT)
        head = F.when(assigned, state(add(_assigned(word)) if level > 0 else s["out"], F.lit(False), F.lit(""), s["left"])).otherwise(state(add(_base(word)), F.lit(True), _base(word), s["left"]))
        rest = (
            F.when(free, state(add(word), s["started"], chain, s["left"]))
            .when(word.startswith("-"), same(F.when(flag.rlike(FLAG), flag).otherwise("_")))
            .when(assigned, same(_assigned(word)))
            .when(word.contains("/") | word.startswith("~") | word.isin(".", ".."), same(way))
            .when((s["left"] > 0) & word.rlike(BARE), state(add(word), s["started"], F.lit(""), s["left"] - 1))
            .otherwise(same(F.lit("_")))
        )
        return (
            F.when(t == "\n", F.when(last.isin(*OPEN), s).otherwise(fresh(add(F.lit(";")))))
            .when(t.isin(*PARTS), fresh(add(t)))
            .when(t.rlike("^[|&;<>()]"), state(add(t), s["started"], s["chain"], s["left"]) if level > 0 else s)
            .when(~s["started"], head)
            .otherwise(rest if level > 0 else s)
        )

    def of(text: Column) -> Column:
        lone = F.regexp_replace(text, rf"{TOKEN}|\s", "") != ""  # a quote that never closes
        tokens = F.filter(F.slice(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lit(1), F.lit(MAX_COMMAND)), lambda t: ~t.startswith("#"))
        told = F.aggregate(tokens, state(none, F.lit(False), F.lit(""), F.lit(BARE_WORDS)), step, lambda s: F.array_join(s["out"], " "))
        return F.when(lone, _fallback(F.trim(line), level)).otherwise(told)

    # each stage is bound once, so that no later one repeats what is before it
    bare = F.transform(F.array(F.regexp_replace(line, r"^\s+|\s+$", "")), lambda x: F.regexp_replace(without_bodies(x), r"\\\n", " "))
    stages = F.transform(F.transform(bare, of), lambda w: F.struct(w.alias("raw"), scrub(w).alias("clean")))
    out = F.transform(stages, lambda x: F.struct(F.substring(x["clean"], 1, MAX_COMMAND).alias("text"), (x["clean"] != x["raw"]).alias("redacted"), (F.length(x["clean"]) >= MAX_COMMAND).alias("cut")))
    return F.when(line.isNotNull(), out[0])


def normalise(line: Column) -> Column:
    """The text of ``normal_form``; an empty line is empty."""
    return normal_form(line)["text"]


def argument_of(argv: Column, flags: tuple[str, ...]) -> Column:
    """The value of the last of these flags in a list of arguments, stated as the next argument or behind ``=``; null without one."""
    named = F.lit(list(flags))

    def value(a: Column, i: Column) -> Column:
        nxt = F.try_element_at(argv, i + 2)
        stated = F.filter(named, lambda f: a.startswith(F.concat(f, F.lit("="))))
        return F.when(F.array_contains(named, a), nxt).when(F.size(stated) > 0, F.substring(a, F.length(stated[0]) + 2, F.lit(1 << 30)))

    return F.try_element_at(F.filter(F.transform(argv, value), lambda v: v.isNotNull()), F.lit(-1))


def setting_of(argv: Column, key: str, flags: tuple[str, ...] = ("-c", "--config")) -> Column:
    """The value of the last ``key=value`` behind one of the flags, without a pair of quotes around it."""
    behind = F.transform(argv, lambda a, i: F.when((i > 0) & F.coalesce(F.try_element_at(argv, i), F.lit("")).isin(*flags) & a.startswith(f"{key}="), F.substring(a, len(key) + 2, 1 << 30)))
    value = F.try_element_at(F.filter(behind, lambda v: v.isNotNull()), F.lit(-1))
    return F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2")


def posture_of(argv: Column, switches: tuple[str, ...], flags: tuple[str, ...], key: str) -> Column:
    """The first of the switches that is there, else the value of the last of the flags, else of the setting."""
    switch = F.try_element_at(F.filter(F.lit(list(switches)), lambda s: F.array_contains(argv, s)), F.lit(1))
    return F.coalesce(switch, argument_of(argv, flags), setting_of(argv, key))
