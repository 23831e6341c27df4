"""The numbered operators on small tables: brute force, edge cases and SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprint, graph, jaccard_join, line_dedup, lm_score, quality, registry, sentencepiece, sharding, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies of several rates, a common line, nulls, empty and one-word texts."""
    rng = random.Random(7)
    vocab = vocabulary(rng, 400)
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [make(rng.randint(20, 120)) for _ in range(30)]
    base = make(150)
    for rate in (0.005, 0.01, 0.02, 0.05):
        for _ in range(8):
            texts.append(" ".join(rng.choice(vocab) if rng.random() < rate else w for w in base.split()))
    texts += [texts[0]] * 4 + [texts[1].upper()] + ["one", "One", "two words", None, "", " \n\t ", "ü" * 30]
    texts += ["common line of some words here\n" + make(12) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


def components_brute(rows, n, num, den):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den", "unit"), [(4, 85, 100, 2_000_000), (5, 80, 100, 2_000_000), (4, 85, 100, 900)])
def test_jaccard_components(spark, corpus, monkeypatch, n, num, den, unit):
    """unit 900 deals the near copies to several blocks, and FREQUENT 4 makes common signatures loud."""
    if unit < 1000:
        monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n, num, den, unit).collect()}
    assert got == components_brute(corpus, n, num, den)


@pytest.mark.parametrize(("n", "num", "den", "frequent"), [(4, 85, 100, 32), (5, 80, 100, 32), (5, 80, 100, 1)])
def test_jaccard_links_across_size_bands(spark, monkeypatch, n, num, den, frequent):
    """Copies that gain or lose words at their end or inside, around every band's end; frequent 1 makes all shared signatures loud."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(11)
    texts = []
    for end in (12, 17, 24, 34, 48, 68, 96, 135, 190):
        for shift in (-1, 0, 2):
            base = [f"{end}x{shift}x{rng.randrange(10**6)}" for _ in range(end + n - 1 + shift)]
            few = max(1, len(base) // 12)
            texts += [base, [*base, "more"], base[:-1], base[few:], base + [f"{end}y{shift}y{k}" for k in range(few)]]
            at = rng.randrange(len(base))
            texts.append([*base[:at], f"{end}z{shift}", *base[at:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), n, num, den).collect()}
    assert got == components_brute(rows, n, num, den)


def test_fine_profiles_part_what_coarse_ones_leave():
    """A star of unrelated sets that coarse profiles connect: fine ones part it; stars are named by their members."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 105).astype(np.uint64)) for _ in range(300)]
    sets.append(np.unique(np.append(sets[0][:-1], np.uint64(5))))
    bands, ptr = jaccard_join._bands(80, 100), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    flat, n = np.concatenate(sets), len(sets)

    def parted(each, apart, heads=(7,)):
        profile = jaccard_join._profiles(flat, ptr, bands, each) * len(heads)
        table = pa.table({"u": list(range(n)) * len(heads), "v": np.repeat(heads, n), "n": np.tile(np.diff(ptr), len(heads)), "profile": pa.array(profile, pa.binary())})
        return jaccard_join._parted(table, 80, 100, apart)

    assert parted(jaccard_join.COARSE, False).num_rows > 20
    assert parted(jaccard_join.FINE, False).to_pylist() == [{"u": n - 1, "v": 0}]
    again = parted(jaccard_join.FINE, True, (7, 8)).to_pydict()
    assert again["u"] == [0, n - 1] * 2
    assert len(set(again["v"])) == 1


def test_a_large_family_is_searched_by_its_heads(spark, monkeypatch):
    """Documents that only a common signature connects: their texts are told once for each head, and no link is lost."""
    rng = random.Random(5)
    base = [[f"b{i}x{rng.randrange(10**9)}" for _ in range(40)] for i in range(30)]
    rows = [(10 * i + k, " ".join([*b[: 40 - k], *(f"c{i}" for _ in range(k))])) for i, b in enumerate(base) for k in range(4)]
    told = []
    real = jaccard_join._links

    def logged(docs, members, keys, *rest):
        told.append((tuple(keys), members.count()))
        return real(docs, members, keys, *rest)

    # every candidate stays with its head and every family is one: the heads of ten in a row make a chain over all of them
    def chained(stars, facts, profile, num, den, apart=False):
        if apart:
            return stars
        order = [r.node for r in facts.orderBy("first.doc_id").select("node").collect()]
        return spark.createDataFrame([(u, order[i]) for i in range(0, len(order) - 1, 4) for u in order[i + 1 : i + 6]], "u long, v long")

    monkeypatch.setattr(jaccard_join, "_links", logged)
    monkeypatch.setattr(jaccard_join, "_near_stars", chained)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 80, 100, 250).collect()}
    assert got == components_brute(rows, 4, 80, 100)
    assert [k for k, _ in told] == [("family", "part"), ("family", "one", "two")]
    assert told[1][1] <= 3 * len(rows)  # by parts of the whole family: more than ten times


def test_jaccard_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None)]
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 3), (0, 3), (3, 3), (3, 3), (4, 4)]
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_ids_with_several_texts(spark):
    """Ids with different texts, null ids and a very long text against all pairs of rows; what keep_one leaves."""
    rng = random.Random(31)
    vocab = vocabulary(rng, 800)
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    near = lambda w: [*w[:-1], "changed"]
    a, b, c, long = make(80), make(90), make(70), make(60_000)
    rows = [(1, a), (3, a), (3, b), (9, near(b)), (5, c), (None, near(c)), (None, make(50)), (7, long), (8, near(long)), (3, b), (None, make(30)), (6, ["w"]), (2, None)]
    rows = [(i, None if t is None else " ".join(t)) for i, t in rows]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 85, 100).collect())
    numbered = components_brute(list(enumerate(t for _, t in rows)), 4, 85, 100)
    lowest = {}
    for k, (_, root) in numbered.items():
        if rows[k][0] is not None:
            lowest[root] = min(lowest.get(root, 10**9), rows[k][0])
    assert got == sorted((rows[k][0] or 0, lowest.get(root, 0), n) for k, (n, root) in numbered.items())
    kept = sorted(((r.doc_id or 0), r.text or "") for r in jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect())
    gone = {(9, rows[3][1]), (0, rows[5][1]), (8, rows[8][1]), (3, rows[1][1])}
    assert kept == sorted((i or 0, t or "") for i, t in rows if (i or 0, t or "") not in gone)


def test_frequent_signatures_are_counted_across_chunks(spark, monkeypatch):
    """Signatures that are frequent within a chunk, in several chunks, and dealt in levels, against all pairs."""
    for name, value in {"FREQUENT": 3, "CHUNK_BYTES": 4000, "RANGE_ENTRIES": 50, "FAN_BITS": 2, "CHUNK_ENTRIES": 200}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(41)
    vocab = vocabulary(rng, 300)
    base = [rng.choice(vocab) for _ in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(rng.choices(range(60), k=60))]
    rows += [(100 + i, " ".join([*base[:30], *(rng.choice(vocab) for _ in range(40))])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), 4, 85, 100).collect()}
    assert got == components_brute(rows, 4, 85, 100)


def test_profiles_part_no_link():
    """Sets in one star: both ways of parting agree, and linked sets are never parted."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 201)], rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(120)]
    bands = jaccard_join._bands(80, 100)

    def parted(some):
        ptr = np.concatenate([[0], np.cumsum([len(s) for s in some])])
        return jaccard_join._near(jaccard_join._profiles(np.concatenate(some), ptr, bands), np.diff(ptr), 80, 100)

    large, small = parted(sets), [parted(sets[k : k + 30]) for k in range(0, 120, 30)]
    assert len(set(large.tolist())) > 1
    for i, j in itertools.combinations(range(120), 2):
        c = len(np.intersect1d(sets[i], sets[j]))
        if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            assert large[i] == large[j]
            assert i // 30 != j // 30 or small[i // 30][i % 30] == small[j // 30][j % 30]
    for k, found in enumerate(small):  # fewer sets, fewer bridges
        for i, j in itertools.combinations(range(30), 2):
            assert found[i] != found[j] or large[30 * k + i] == large[30 * k + j]


def test_overlaps_by_bitmaps_equal_merging(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    ptr, order = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), rng.permutation(40)
    x, y = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    want = [len(np.intersect1d(sets[order[i]], sets[order[j]])) for i, j in zip(x, y, strict=True)]
    for dense in (1 << 27, 0):
        monkeypatch.setattr(jaccard_join, "DENSE_BYTES", dense)
        assert jaccard_join._Overlaps(np.concatenate(sets), ptr, order)(x, y).tolist() == want


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = rng.integers(0, 1 << 62, rng.integers(0, 14)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 61)], own])))
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = jaccard_join.tree_links(np.concatenate(sets), ptr, 85, 100)
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = components_sets([set(s.tolist()) for s in sets])
    assert [root(i) for i in range(len(sets))] == want


def components_sets(sets):
    up = list(range(len(sets)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [root(i) for i in range(len(sets))]


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup_keeps_first_place(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"x\n{long}\ny"), (1, f"p\n{long}"), (3, None), (4, ""), (5, "\n\n"), (1, f"p\n{long}"), (None, f"{long}\nz"), (6, "same\nlines\nhere"), (7, "same\nlines\nhere"), (8, "é\r\nq")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, removed string").drop("removed")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect()), key=str)
    # null ids come first, so the row without an id holds the first place of the long line
    want = sorted([(2, "x\ny"), (1, "p"), (3, None), (4, ""), (5, "\n\n"), (1, "p"), (None, f"{long}\nz"), (6, "same\nlines\nhere"), (7, ""), (8, "é\r\nq")], key=str)
    assert got == want


CLASHING = "doc_id long, text string, d int, k int, removed string, n_lines int, starts int, key int, score string, ids string, shard int, h1 int, rep int, place int, x int, fold int, label string"


def test_line_dedup_removes_whole_passages(spark):
    """Passages of 2 to 20 lines between random lines stay in their first document only; other lines stay."""
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    plans = [(2, 30), (2, 25), (3, 20), (3, 45), (4, 20), (5, 20), (6, 20), (20, 12)]
    rows, want = [], {}
    for size, n in plans:
        passage = [line(n) for _ in range(size)]
        passage[size // 2 : size // 2] = [""] * (size > 3)
        for copy in range(6):
            head, tail = ([line(rng.randint(3, 40)) for _ in range(rng.randint(1, 8))] for _ in range(2))
            rows.append((len(rows), "\n".join([*head, *passage, *tail])))
            want[rows[-1][0]] = rows[-1][1] if copy == 0 else "\n".join([*head, *tail])
    rows += [(100, f"{line(60)}\n" + "\n".join([line(9)] * 12)), (None, None), (101, "")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([*rows, rows[1]], SCHEMA).repartition(3)).collect()}
    assert {i: got[i].text for i in want} == want
    assert all(got[i].n_lines - got[i].removed_lines == len(t.split("\n")) for i, t in want.items())
    # two lines of a line that repeats itself stay at the first place
    assert rows[-3][1].startswith("\n".join(rows[-3][1].split("\n")[:3])) and got[100].text == "\n".join(rows[-3][1].split("\n")[:3])
    assert got[None].text is None and got[101].text == ""


def test_clashing_columns(spark):
    row = (1, "a b c d e f g h", *[1, 2, "r", 3, 4, 5, "s", "i", 6, 7, 8, 9, 10, 11, "l"])
    df = spark.createDataFrame([row, (2, *row[1:])], CLASHING)
    assert line_dedup.line_dedup(df).select("d", "k", "starts", "key", "score").count() == 2
    assert jaccard_join.keep_one(df).columns == df.columns and jaccard_join.keep_one(df).count() == 1
    assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, df.select("doc_id", F.lit(1).alias("label")))).dtypes[-1] == ("score", "double")
    assert sentencepiece.encode(df).dtypes[-1] == ("ids", "array<int>")
    assert fingerprint.fingerprints(df).count() == fingerprint.neighbour_fingerprints(df).count() == 2
    assert lm_score.score_documents(df).count() == sharding.shard_documents(df, [1.0]).count() == 2
    assert sharding.assign_shards(df, F.col("doc_id"), [1.0, 1.0]).where("shard > 1").count() == 0
    assert quality.quality_scores(df, df.select("doc_id", F.lit(1).alias("label"))).count() == 2
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.decontaminate(df, bench).count() == 0 and decontaminate.find_leaks(df, bench).count() == 2


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Chunks of one hash but different bytes are no repeats: here all hashes of chunks and pairs are the same."""
    monkeypatch.setattr(line_dedup, "_hash", lambda value: F.lit(1).cast("long"))
    long = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(1, f"a\n{long[0]}\nb"), (2, f"c\n{long[1]}"), (3, f"{long[0]}\nd"), (4, f"{long[1]}\ne\n{long[2]}"), (5, "x " * 200_000)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "d", 4: f"e\n{long[2]}", 5: rows[4][1]}
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_boundaries_shift_with_the_lines(spark):
    shared = [f"shared line number {i}" for i in range(30)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["own a", "own b", *shared, "own c"]))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines >= 22
    assert all(x in got[2].text.split("\n") for x in ("own a", "own b", "own c"))


def test_fingerprints(spark, corpus):
    rows = sorted(((i, t or "") for i, t in corpus), reverse=True)
    got = {r.doc_id: r for r in fingerprint.neighbour_fingerprints(spark.createDataFrame(corpus, SCHEMA).repartition(4), ranges=7).collect()}
    alone = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(corpus, SCHEMA)).collect()}
    sketches = {i: set(re.findall(".{12}", f)) for i, f in alone.items()}
    for k, (i, t) in enumerate(rows):
        j, nxt = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), alone[i])
        a, b = sketches[i], sketches[j]
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        e = set(re.findall(".{12}", r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)
    assert all(bool(f) == bool(words(dict(corpus)[i])) for i, f in alone.items())


def kept_hashes_brute(text, words_=fingerprint.WORDS, scale=fingerprint.SCALE):
    """What the fingerprint should keep, from the shingles one by one."""
    from tidemark.llm.text import arrow_bytes, shingles, word_hashes

    w, out = words(text), set()
    for k in range(max(1, len(w) - words_ + 1) if w else 0):
        h, _ = shingles(*word_hashes(*arrow_bytes(pa.array([" ".join(w[k : k + words_])]))), words_)
        out.add(int(h[0]) >> 16)
    low = {h for h in out if h < (1 << 48) // scale}
    return "".join(f"{h:012x}" for h in sorted(low)) if low or not out else f"~{min(out):012x}"


def test_fingerprints_keep_what_is_below_the_threshold_and_merge(spark):
    rng = random.Random(13)
    vocab = vocabulary(rng, 400)
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 6, 7, 12, 40, 400]))) for _ in range(120)]
    df = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    f = {r.doc_id: r.fingerprint for r in df.collect()}
    assert all(f[i] == kept_hashes_brute(t) for i, t in enumerate(texts))
    assert sum(x.startswith("~") for x in f.values()) > 5
    # a text with the shingles of both, and no others: the two, apart from each other by line ends that shingles can't cross
    pairs = [(a, b) for a in range(0, 60) for b in (a + 60,)]
    union = lambda a, b: {f[x][k : k + 12] for x in (a, b) if not f[x].startswith("~") for k in range(0, len(f[x]), 12)}
    rows = spark.createDataFrame([(a, b, f[a], f[b]) for a, b in pairs], "a int, b int, fa string, fb string").select("a", "b", fingerprint.merged(F.col("fa"), F.col("fb")).alias("m")).collect()
    for r in rows:
        low = union(r.a, r.b)
        bare = [f[x] for x in (r.a, r.b) if f[x]]
        assert r.m == ("".join(sorted(low)) if low else min(bare, default=""))


def test_fingerprint_estimates_follow_the_exact_jaccard(spark):
    rng = random.Random(14)
    vocab = vocabulary(rng, 900)
    rows = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(500)]
        k = rng.randint(0, 500)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:k] + [rng.choice(vocab) for _ in range(500 - k)]))]
    f = {r.doc_id: set(re.findall(".{12}", r.fingerprint)) for r in fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    t = dict(rows)
    error = []
    for i in range(60):
        a, b = shingle_set(t[2 * i], 5), shingle_set(t[2 * i + 1], 5)
        error.append(len(f[2 * i] & f[2 * i + 1]) / len(f[2 * i] | f[2 * i + 1]) - len(a & b) / len(a | b))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_fingerprint_neighbours_of_odd_tables(spark):
    """Repeated and null ids, one row, no rows, a very long text."""
    long = "word " * 300_000
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "zz"), (None, "q"), (None, None), (7, long), (-3, "")]
    got = fingerprint.neighbour_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3), ranges=5).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i or 0, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    one = fingerprint.neighbour_fingerprints(spark.createDataFrame([(1, "a b")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.neighbour_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_containment_and_merge(spark):
    rng = random.Random(3)
    vocab = vocabulary(rng, 900)
    part, rest = (" ".join(rng.choice(vocab) for _ in range(n)) for n in (400, 4000))
    df = fingerprint.fingerprints(spark.createDataFrame([(1, part), (2, f"{rest} {part}"), (3, rest)], SCHEMA))
    f = {r.doc_id: r.fingerprint for r in df.collect()}
    row = spark.createDataFrame([(f[1], f[2], f[3])], "a string, b string, c string").select(fingerprint.containment(F.col("a"), F.col("b")).alias("in_b"), fingerprint.containment(F.col("a"), F.col("c")).alias("in_c"), fingerprint.merged(F.col("a"), F.col("c")).alias("m")).first()
    assert row.in_b == 1.0 and row.in_c < 0.1
    assert set(re.findall(".{12}", f[1])) | set(re.findall(".{12}", f[3])) == set(re.findall(".{12}", row.m))


def test_url_filter_equals_all_rules(spark):
    urls = [None, "", "no scheme", "http://com", "http://com/", "HTTPS://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/de", "http://x.net/es/1", "http://x.net/ES/1", "http://notnet/es/", "ftp://q.net?/es/", "http://spam-farm.example.org/", "http://b.casino-win.example.net/de/", "http://example.com/en/"]
    got = [tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.CONTRACT + url_filter.PATTERNS).orderBy("page_id").collect()]
    rules = url_filter.CONTRACT + url_filter.PATTERNS
    for url, (host, path, rule, verdict, pattern, tried) in zip(urls, got, strict=True):
        if not url or "://" not in url:
            assert (host, path, rule, verdict) == ("", "", None, "allow")
            continue
        rest = url.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        assert (host, path) == (h.translate(LOWER), re.match(r"[^?#]*", rest[len(h) :])[0])
        fits = [r for r in rules if re.match(r.pattern, host + path)]
        best = min(fits, key=lambda r: (r.tier, -len(r.name), r.name), default=None)
        assert (rule or pattern) == (best.name if best else None) and verdict == (best.action if best else "allow")
        assert tried < len(rules)


def test_url_patterns_with_suffixed_hosts_equal_all_regexes(spark):
    stems = ["ad-track", "ads-track", "spam-farm", "spam-farms", "casino", "casino-win", "adult-x", "cheap-pill", "cheap-pills", "free-bet", "free-bets"]
    hosts = [f"{before}{stem}{after}" for stem in stems for before in ("", "b.", "x", "x-", "ad-") for after in ("", "er", "ing", "s", "-er", "er-1", ".a", "_b")]
    urls = [f"http://{h}.example.{top}/{path}" for h in hosts for top, path in (("net", ""), ("org", "de/"))]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.CONTRACT + url_filter.PATTERNS
    some = 0
    for r in url_filter.filter_urls(rows, rules).collect():
        fits = [x for x in rules if re.match(x.pattern, r.host + r.path)]
        best = min(fits, key=lambda x: (x.tier, -len(x.name), x.name), default=None)
        assert ((r.rule or r.pattern), r.verdict) == (best.name if best else None, best.action if best else "allow"), r
        some += bool(r.pattern == "ads-track" and "track.example" not in r.host)
    assert some


def test_thousands_of_rules_from_a_table_equal_all_regexes(spark):
    """Rules with read tokens, given ones and none; null, empty, repeated and very long urls; clashing columns; empty tables."""
    rng = random.Random(8)
    names = vocabulary(rng, 60)
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(2500):
        pattern = rng.choice([
            rf"(?:.*\.)?{re.escape(host())}/", rf"{rng.choice(names)}-{rng.choice(names)}", rf"[^/]*\b{rng.choice(names)}\b", rf"[^/]*/{rng.choice(names)}/.*\.(gif|png)$", rf"{rng.choice(names)[:3]}s?{rng.choice(names)}", r"[^/]*[0-9]{5}",
        ])
        rows.append((f"r{i}", rng.choice(["allow", "block"]), pattern, None, i % 2))
    table = spark.createDataFrame([*rows, (None, "block", "x", None, 0), ("x", None, "x", None, 0)], "name string, action string, pattern string, tokens array<string>, tier int")
    rules = url_filter.rules_from(table)
    assert len(rules) == 2500 and 0 < sum(not r.tokens for r in rules) < 1000
    urls = [None, "", "x", "http://" + "a." * 5000 + "com/" + "b/" * 5000]
    urls += [f"http://{host()}/{rng.choice(names)}/{rng.choice(names)}.gif?x" for _ in range(150)] + [f"http://{rng.choice(names)}-{rng.choice(names)}.{host()}{rng.randint(0, 10**6)}/" for _ in range(150)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[9], urls[9]])], "page_id long, url string, host string, rule string")
    tried = 0
    compiled = [(r, re.compile(r.pattern, re.S)) for r in rules]
    for r in url_filter.filter_urls(df, rules).collect():
        fits = [x for x, c in compiled if c.match(r.host + r.path)]
        best = min(fits, key=lambda x: (x.tier, -len(x.name), x.name), default=None)
        assert ((r.rule or r.pattern), r.verdict) == (best.name if best else None, best.action if best else "allow"), r
        tried += r.tried
    assert tried < 0.5 * len(rules) * len(urls)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0 and url_filter.filter_urls(df, ()).where("verdict = 'block'").count() == 0


def test_literal_tokens_are_whole_in_every_match():
    for pattern, want in {r"^ads-track\.": ("ads", "track"), r"[^/]*\bads?-track": (), r"(?:.*\.)?a\.com/": ("a", "com"), "bff-x": ("bff",), r"(?:.*\.)?abc/": ("abc",), r"(?:x\.|y)?abc/": (), r"a(?:-)?b/": (), r"(?:-)+b/": ("b",), "x*b/": (), r"x[0-9]+y-z/": ("z",), "(?i)ad-x/": (), r"a_b-c/": ("c",), r"(a-|b-)c/": (), "": (), r"\Aqq$": ("qq",)}.items():
        assert url_filter.literal_tokens(pattern) == want, pattern


def test_rarest_token_is_the_index_key():
    rules = (url_filter.host_rule("common.rare.org", "/", "block"),)
    assert list(url_filter.rule_index(rules, {"common": 9, "rare": 1, "org": 50})) == ["rare"]
    assert url_filter.host_rule("a.b", "/en", "block").tokens == ("a", "b")  # 'en' may be part of a longer word


def test_sharding_laws(spark):
    ids = [(i, "x" * (i % 50)) for i in range(3000)] + [(None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame(ids, SCHEMA)
    rows = sharding.shard_documents(df, [1.0, 2.0, 1.0]).collect()
    by = Counter(r.shard for r in rows)
    assert by[1] > 1.7 * by[0] and by[1] > 1.7 * by[2]
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(df, [1.0, 2.0, 1.0, 1.0]).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    assert all(r.text_crc32 == zlib.crc32(("x" * (r.doc_id % 50)).encode()) for r in rows if r.doc_id not in (None, 5))
    assert sharding.shard_documents(df.limit(0), [1.0]).count() == 0


def test_slot_buckets_follow_the_rows(spark):
    assert sharding.slot_buckets(0, 40) == sharding.slot_buckets(10**6, 40) == 64
    assert sharding.slot_buckets(10**11, 40) >= 10**11 / 40 / sharding.SLOT_ROWS
    df = spark.createDataFrame([(1, "x" * 1_000_000), *((7, f"t{i}") for i in range(300)), *((None, None) for _ in range(20))], SCHEMA)
    rows = sharding.assign_shards(df, F.col("doc_id"), [1.0] * 3, spread=F.col("text")).where("doc_id = 7").select("shard", "slot_bucket").distinct().collect()
    assert len({r.shard for r in rows}) == 1 and len(rows) > 40
    got = sharding.shard_documents(df, [1.0] * 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], SCHEMA)
    sharding.write_shards(df, [1.0] * 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rng = random.Random(5)
    texts = ["", " ", "   ", "\n\n a", "  a  b ", " " * 40 + "b" + " " * 37, "\t", "é́ ﬁ Ａ", "漢字かな", "🙂🙂 a🙂", "a\x00b", "a▁b", "<s> </s>", "aaaaaaaaaab" * 5, "12345" * 9, "x" * 3000]
    texts += ["".join(rng.choice("ab ehtrn  ing▁é漢\n0=") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], SCHEMA)
    coded = sentencepiece.encode(df, check=True)
    got = {r.doc_id: r for r in sentencepiece.decode(coded).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode(t), repr(t)
        assert got[i].round_trip and got[i].decoded == t.replace("▁", " ")
    assert got[len(texts)].ids is None and got[len(texts)].decoded is None
    assert sentencepiece.encode(df.limit(0)).count() == 0


def test_sentencepiece_refuses_other_models():
    def field(number, value):
        return bytes([number << 3 | (0 if isinstance(value, int) else 2)]) + (bytes([value]) if isinstance(value, int) else bytes([len(value)]) + value)

    for trainer, normal in ((b"", b""), (field(3, 1), b""), (field(3, 2), field(2, b"x")), (field(3, 2), b"")):
        with pytest.raises(ValueError):
            sentencepiece.Pieces(field(1, field(1, b"a")) + field(2, trainer) + field(3, normal))


def test_sentencepiece_round_trip_of_documents(spark):
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rows = sentencepiece.encode(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), check=True).collect()
    assert all(r.round_trip for r in rows) and all(r.ids == lib.encode(r.text) for r in rows)


def lm_brute(rows):
    count = Counter()
    tokens = {}
    for i, t in rows:
        tokens[i] = [*words(t), "\n"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def lm_score_brute(rows):
    """Scores by dictionaries of n-grams, with weights from plain loops of expectation-maximisation over rounded probabilities."""
    sent = {i: ["<", "<", *words(t), "\n"] for i, t in rows}
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i in sent}

    def counts(ids):
        c = Counter()
        for i in ids:
            s = sent[i]
            c[("<",)] += 1
            c[("<", "<")] += 1
            for k in range(2, len(s)):
                for n in (1, 2, 3):
                    c[tuple(s[k - n + 1 : k + 1])] += 1
        return c

    def estimates(c, s, k):
        total = sum(v for g, v in c.items() if len(g) == 1 and g != ("<",))
        two, one = c[tuple(s[k - 2 : k])], c[(s[k - 1],)]
        seen = [two > 0, one > 0, True, True]
        log = lambda x: min(math.ceil(math.log2(x + 1)), lm_score.BUCKETS - 1)
        p = [c[tuple(s[k - n + 1 : k + 1])] / max(1, d) for n, d in ((3, two), (2, one), (1, total))]
        return (log(two) if two else lm_score.BUCKETS + log(one)), seen, p

    core = counts(i for i in sent if fold[i] not in (2, 6))
    v = sum(len(g) == 1 for g in core) - (("<",) in core)
    grid = lambda x: 2.0 ** -(round(-math.log2(x) * lm_score.GRID) / lm_score.GRID) if x > 0 else 0.0
    seen_cells, able = Counter(), {}
    for i in sent:
        if fold[i] == 6:
            for k in range(2, len(sent[i])):
                b, seen, p = estimates(core, sent[i], k)
                seen_cells[(b, *map(grid, p))] += 1
                able[b] = seen
    for b in range(2 * lm_score.BUCKETS):
        able.setdefault(b, [b < lm_score.BUCKETS and b > 0, b % lm_score.BUCKETS > 0, True, True])
    w = {b: [x / sum(s) for x in s] for b, s in able.items()}
    for _ in range(60):
        total = {b: [0.0] * 4 for b in w}
        for (b, *p), n in seen_cells.items():
            joint = [x * y for x, y in zip(w[b], [*p, 1 / (v + 1)], strict=True)]
            for k in range(4):
                total[b][k] += n * joint[k] / sum(joint)
        overall = [sum(t[k] for t in total.values()) for k in range(4)]
        overall = [x / max(1, sum(overall)) for x in overall]
        for b in w:
            raw = [(x + o + 1e-6) * s for x, o, s in zip(total[b], overall, able[b], strict=True)]
            w[b] = [x / sum(raw) for x in raw]
    every = counts(i for i in sent if fold[i] != 2)
    v = sum(len(g) == 1 for g in every) - (("<",) in every)
    out = {}
    for i, s in sent.items():
        parts = [estimates(every, s, k) for k in range(2, len(s))]
        out[i] = sum(math.log10(sum(x * y for x, y in zip(w[b], [*p, 1 / (v + 1)], strict=True))) for b, _, p in parts)
    return out


@pytest.mark.parametrize("fan", [12, 2])
def test_lm_counts_and_scores_equal_brute_force(spark, corpus, monkeypatch, fan):
    """Several chunks and ranges; fan 2 deals them in levels, with packs of a few cells."""
    for name, value in {"CHUNK_BYTES": 2000, "RANGE_IDS": 300, "FAN_BITS": fan, "PACK_CELLS": 3}.items():
        monkeypatch.setattr(lm_score, name, value)
    long = [(1000, "one two three two one " * 3000), (1001, None)]
    rows = [*corpus, *long]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    score = lm_score_brute(rows)
    for i, (n, known, train, base) in lm_brute(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, n, known, train)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score[i], rel=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edge_tables(spark):
    assert lm_score.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None), (1, "a"), (1, "a"), (2, "b a")]
    got = lm_score.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and {r.train_tokens for r in got} == {sum(len(words(t)) + 1 for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2)}
    held = [(i, "x y") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in lm_score.score_documents(spark.createDataFrame(held, SCHEMA)).collect())


def test_lm_is_a_distribution():
    """The mixture over all known words and the unseen ones' share sums to one for each context."""
    cells = np.array([[1, 0, 2, 8, 5], [2, 4, 5, 8, 9], [lm_score.BUCKETS, -1, -1, 12, 3], [3, -1, -1, -1, 2]])
    weights = lm_score.learn_weights(cells, 1 / 11)
    assert np.allclose(weights.sum(1), 1, atol=1e-6) and (weights[:, 2:] > 0).all()
    assert not weights[lm_score.BUCKETS :, 0].any() and not weights[lm_score.BUCKETS, 1] and weights[lm_score.BUCKETS + 1, 1] > 0


def test_cells_round_trip():
    from tidemark.llm import dealing

    rng = np.random.default_rng(2)
    value = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1))
    core = rng.integers(0, 1 << 40, 500, dtype=np.uint64)
    for bits, width in ((0, 64), (5, 64), (5, 40)):
        kept = value >> np.uint64(64 - width)
        table = pa.Table.from_batches(list(dealing.cells(kept << np.uint64(64 - width), 7, bits, {"core": core}, width)))
        assert (dealing.unpack(table, "value") == kept).all() and (dealing.unpack(table, "core") == core).all()
        assert table.column("p").to_pylist() == sorted({int(x) >> (64 - bits) if bits else 0 for x in value.tolist()})
    assert dealing.levels_of(0, 12) == [0] and dealing.levels_of(15, 6) == [6, 6, 3]
    assert len(dealing.unpack_one(dealing.pack(np.zeros(0, np.uint64)), 0, np.uint64)) == 0


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 300)
    rows = []
    for i in range(600):
        toxic = int(i % 5 == 0)
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        if toxic:
            for bad in rng.sample(["idiot", "moron", "scum"], 2):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit_toxicity(df, df.where("doc_id < 400").select("doc_id", "label"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df.select("doc_id", "text"), model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in rows)


def test_toxicity_without_labels_and_edge_texts(spark):
    df = spark.createDataFrame([(1, None, 5.0), (None, "", 1.0), (2, "x" * 100_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, none)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(2, 0)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, one)).collect())


def test_no_model_calls_nothing_toxic(spark):
    df = spark.createDataFrame([(i, "x y z") for i in range(6)], SCHEMA)
    for labels in ([(1, 0), (3, 1)], [(1, 1), (2, 1)], [(1, 0)], []):
        model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, label int"))
        assert model is None and [r.score for r in toxicity.score_toxicity(df, model).collect()] == [0.0] * 6
    assert toxicity.score_toxicity(df.limit(0), None).count() == 0


def test_toxicity_equals_plain_newton_logistic(spark):
    """Features by sets of character n-grams, their ratios by counting, and weights by Newton's method: nearly the same scores."""
    rng = random.Random(19)
    vocab = [*vocabulary(rng, 200), "é漢字ü", "ñandú"]
    rows = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 60))]
        if i % 4 == 0:
            for bad in rng.sample(["idiöt", "moron", "scum", "loser"], 2):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df.select("doc_id", "text"), toxicity.fit_toxicity(df, df.where("doc_id < 300").select("doc_id", "label"))).collect()}
    g = toxicity.GRAM
    sets = {i: {t[k : k + g] for k in range(len(t) - g + 1)} for i, t, _ in rows}
    train = [(i, y) for i, _, y in rows if i < 300]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    p, q = Counter(), Counter()
    for i, y in train:
        (p if y else q).update(sets[i])
    ratio = {}
    for f in p.keys() | q.keys():
        r = math.log((p[f] + 1) / (n1 + 2)) - math.log((q[f] + 1) / (n0 + 2))
        rate = (p[f] + q[f] + 1) / (n1 + n0 + 2)
        z = (p[f] / n1 - q[f] / n0) / math.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        if p[f] + q[f] >= 3 and abs(z) > 3.5 and abs(r) > 0.5:
            ratio[f] = r
    names = sorted(ratio)
    x = lambda i: [ratio[f] if f in sets[i] else 0.0 for f in names] + [1.0]
    X, y = np.array([x(i) for i, _ in train]), np.array([y for _, y in train])
    w, penalty = np.zeros(X.shape[1]), np.diag([1e-4] * len(names) + [1e-9]) * len(train)
    for _ in range(30):
        h = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        w += np.linalg.solve((X * (h * (1 - h) + 1e-9)[:, None]).T @ X + penalty, X.T @ (y - h) - penalty @ w)
    margin = np.array([np.array(x(i)) @ w for i, _, _ in rows])
    assert all((got[i] >= 0.5) == (m > 0) == bool(t) for (i, _, t), m in zip(rows, margin, strict=True))
    order = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(order(margin), order([got[i] for i, _, _ in rows]))[0, 1] > 0.8


def test_characters_of_several_bytes():
    from tidemark.llm.text import arrow_bytes

    points, ptr = toxicity.code_points(*arrow_bytes(pa.array(["aé漢🙂", "", "B\n", None, "ü"])))
    assert ptr.tolist() == [0, 4, 4, 6, 6, 7]
    assert [int(x).to_bytes(4, "big").lstrip(b"\0").decode() for x in points.tolist()] == list("aé漢🙂b ü")


def test_toxicity_sample_counts_an_id_once(spark):
    rng = random.Random(10)
    rows = [(i, ("scum " if i % 3 == 0 else "kind ") + " ".join(rng.choices(["house", "river", "stone"], k=9))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, label int")
    once, often = (toxicity.fit_toxicity(spark.createDataFrame(r, SCHEMA), labels) for r in (rows, rows + [rows[1]] * 40))
    order = [np.argsort(m["feature"]) for m in (once, often)]
    assert np.array_equal(once["feature"][order[0]], often["feature"][order[1]]) and len(once["feature"])
    assert np.allclose(once["weight"][order[0]], often["weight"][order[1]]) and math.isclose(once["bias"], often["bias"])


def held_out_accuracy(spark, f, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in f(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    return sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)


def test_held_out_accuracy(spark):
    assert held_out_accuracy(spark, registry.queries()["op5_quality"], "quality") > 0.95
    assert held_out_accuracy(spark, registry.queries()["op8_toxicity"], "toxic") > 0.9


def test_quality_equals_a_plain_discriminant(spark):
    """Means, shrunk covariances and log-densities by loops over single rows; repeated documents and labels count once."""
    rng = random.Random(23)
    vocab = vocabulary(rng, 300)
    rows = []
    for i in range(300):
        good = i % 3 != 0
        w = [rng.choice(vocab if good or rng.random() < 0.7 else ["$$", "BUY", "!!", "zz"]) for _ in range(rng.randint(5, 120))]
        rows.append((i, ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9))))
    rows += [rows[4]] * 30 + [(None, "x"), (900, None)]
    labels = [(i, int(i % 3 != 0)) for i in range(200)] + [(7, 1)] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.score for r in quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, label int")).collect()}
    x = {r.doc_id: np.array(r.x) for r in quality.document_statistics(df).collect()}
    ids = sorted({i for i, _ in labels})
    X, y = np.stack([x[i] for i in ids]), np.array([dict(labels)[i] for i in ids])
    mean, scale = X.mean(0), np.sqrt(np.maximum(X.var(0), 1e-9))
    Z = (X - mean) / scale
    mu = {k: Z[y == k].mean(0) for k in (0, 1)}
    cov = {k: sum(np.outer(z - mu[k], z - mu[k]) for z in Z[y == k]) / (y == k).sum() for k in (0, 1)}
    common = sum(cov[k] * (y == k).mean() for k in cov)

    def density(z, k):
        c = 0.8 * cov[k] + 0.2 * common
        c = 0.95 * c + 0.05 * np.diag(np.diag(common) + 0.05)
        return math.log((y == k).mean()) - 0.5 * math.log(np.linalg.det(c)) - 0.5 * (z - mu[k]) @ np.linalg.inv(c) @ (z - mu[k])

    for i, score in got.items():
        z = np.clip((x[i] - mean) / scale, -4, 4)
        assert score == pytest.approx(1 / (1 + math.exp(-np.clip(density(z, 1) - density(z, 0), -40, 40))), abs=1e-4)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 50_000), (3, "\n\n")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in quality.quality_scores(df, none).collect()] == [0.5] * 4
    one_class = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, label int")
    assert all(r.score == 0.5 for r in quality.quality_scores(df, one_class).collect())
    assert quality.document_statistics(df.limit(0)).count() == 0


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One two, two.\nOne two, two.\n", "", "É9 ***", "a\n\nb"]
    from tidemark.llm.text import arrow_bytes

    whole = quality.statistics(*arrow_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(*arrow_bytes(pa.array([t])))[0])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(11)
    vocab = vocabulary(rng, 3000)
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [(i, item(rng.randint(15, 60))) for i in range(30)]
    docs, leaks = [], set()
    for i in range(200):
        w = item(rng.randint(0, 400))
        if i % 4 == 0:
            k, text = bench[rng.randrange(30)]
            text = [x if rng.random() > 0.1 else rng.choice(vocab) for x in text] if i % 8 == 0 else text
            at = rng.randint(0, len(w))
            w = w[:at] + text + w[at:]
            leaks.add((i, k))
        docs.append((i, " ".join(w).capitalize()))
    return docs, [(i, " ".join(t)) for i, t in bench], leaks


def leaks_by_all_windows(docs, bench):
    """(doc, item) by the longest common subsequence of every window of a passage's size and a quarter more, at every word."""
    s, out = decontaminate.SETTINGS, set()
    for k, item in bench:
        w = words(item)
        parts = -(-len(w) // decontaminate.LONGEST)
        for j in range(parts):
            passage = w[len(w) * j // parts : len(w) * (j + 1) // parts]
            n, tail = len(passage), passage[-8:]
            wide = n * 5 // 4
            for i, text in docs:
                d = words(text)
                for a in range(max(1, len(d) - wide + 1)):
                    window = d[a : a + wide]
                    if len(set(window) & set(passage)) < s["loose"] * len(set(passage)) - (n - len(set(passage))):
                        continue  # a subsequence has at most as many words
                    share = lcs(passage, window) / n
                    if share >= s["strict"] or (share >= s["loose"] and lcs(tail, window) / len(tail) >= s["right"]):
                        out.add((i, k))
                        break
    return out


def test_leaks_against_all_windows(spark):
    """Passages with words replaced, inserted, deleted and swapped; small vocabulary, so that windows look alike."""
    rng = random.Random(21)
    vocab = vocabulary(rng, 500)
    item = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [(i, item(rng.randint(5, 70))) for i in range(40)]
    change = {
        "same": lambda w: w, "replaced": lambda w: [x if rng.random() > 0.3 else rng.choice(vocab) for x in w], "inserted": lambda w: [y for x in w for y in ([x, rng.choice(vocab)] if rng.random() < 0.2 else [x])],
        "deleted": lambda w: [x for x in w if rng.random() > 0.2], "swapped": lambda w: [w[min(len(w) - 1, max(0, k + rng.choice([-1, 0, 0, 1])))] for k in range(len(w))],
    }
    docs = []
    for kind in change.values():
        for k, text in rng.sample(bench, 24):
            host = item(rng.randint(0, 150))
            at = rng.randint(0, len(host))
            docs.append((len(docs), " ".join([*host[:at], *kind(text), *host[at:]])))
    bench = [(i, " ".join(t)) for i, t in bench]
    want = leaks_by_all_windows(docs, bench)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want) > 90 and len(want & got) >= 0.97 * len(want)
    text, items = dict(docs), dict(bench)
    for r in found:  # what else is found is a leak of a longer window
        assert (r.doc_id, r.item_id) in want or lcs(words(items[r.item_id]), words(text[r.doc_id])) >= decontaminate.SETTINGS["loose"] * min(48, len(words(items[r.item_id]))) / 2


def test_bitmaps_and_gate_lose_no_leak(leaky, monkeypatch):
    """The bitmaps' bound drops nothing that the subsequence check would keep."""
    docs, bench, _ = leaky
    from tidemark.llm.text import arrow_bytes

    space = np.random.default_rng(3).normal(size=(decontaminate.FEATURES, 32)).astype(np.float32)
    items = decontaminate.Items([i for i, _ in bench], pa.array([t for _, t in bench], pa.large_string()), np.ones(decontaminate.FEATURES, np.float32), space, 8)
    found = decontaminate.plain_words(*arrow_bytes(pa.array([t for _, t in docs])))
    every = decontaminate.SETTINGS | {"cosine": -2.0}
    with_maps = decontaminate._leaks(items, *found, **every)
    items.slack[:] = 1000
    without = decontaminate._leaks(items, *found, **every)
    assert [x.tolist() for x in with_maps[:2]] == [x.tolist() for x in without[:2]] and len(with_maps[0]) > 40


def test_short_and_unspaced_items_leak_exactly(spark):
    bench = [(1, "four words of answer"), (2, "Yes!"), (3, "two words"), (4, "日本の首都は東京です"), (5, ""), (6, None), (7, "two words")]
    docs = [(1, "so: Four words, of answer. End"), (2, "four words of no answer"), (3, "yes"), (4, "oh yes"), (5, "the two\nwords"), (6, "two other words"), (7, "質問。日本の首都は東京です。はい"), (8, None), (9, "")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2), (5, 3), (5, 7), (7, 4)}


def test_orthonormal_keeps_the_range():
    rng = np.random.default_rng(4)
    z = (rng.normal(size=(640, 5)) @ rng.normal(size=(5, 12))).astype(np.float32)  # rank 5 of 12
    q = decontaminate.orthonormal(z.copy()).astype(float)
    assert np.allclose(np.sort(np.linalg.eigvalsh(q.T @ q)), [0] * 7 + [1] * 5, atol=1e-4)
    assert np.allclose(q @ (q.T @ z), z, atol=1e-3)
    assert not decontaminate.orthonormal(np.zeros((640, 12), np.float32)).any()


def test_subsequence_by_bits_equals_table():
    rng = random.Random(12)
    a = [rng.choice("abcdefgh") for _ in range(40)]
    texts = pa.array([" ".join(a)], pa.large_string())
    items = decontaminate.Items([1], texts, np.ones(decontaminate.FEATURES, np.float32), np.ones((decontaminate.FEATURES, 2), np.float32), 8)
    for _ in range(20):
        b = [rng.choice("abcdefghxyz") for _ in range(60)]
        from tidemark.llm.text import arrow_bytes

        w, _ = decontaminate.plain_words(*arrow_bytes(pa.array([" ".join(b)])))
        full, tail = decontaminate._subsequence(items, w, np.array([0]), np.array([60]), np.array([0]))
        assert (full[0], tail[0]) == (lcs(a, b), lcs(a[-8:], b))


def test_leaks_do_not_depend_on_the_segments_of_a_long_text(leaky, monkeypatch):
    docs, bench, _ = leaky
    from tidemark.llm.text import arrow_bytes

    rng = np.random.default_rng(3)
    space = rng.normal(size=(decontaminate.FEATURES, 32)).astype(np.float32)
    items = decontaminate.Items([i for i, _ in bench], pa.array([t for _, t in bench], pa.large_string()), np.ones(decontaminate.FEATURES, np.float32), space, 8)
    data, offsets = arrow_bytes(pa.array([" ".join(t for _, t in docs), "", None, docs[4][1], "a b c"]))
    found = []
    data, offsets = decontaminate.plain_words(data, offsets)
    for size in (1 << 16, 3, 1):
        monkeypatch.setattr(decontaminate, "SEGMENT", size)
        text, item, near, share, told = decontaminate._leaks(items, data, offsets, **decontaminate.SETTINGS)
        found.append((text.tolist(), item.tolist(), np.round(near, 4).tolist(), share.tolist(), told.tolist()))
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 20


def test_decontaminate_keeps_clean_rows(spark, leaky):
    docs, bench, leaks = leaky
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(900, None, "x", 1), (901, "", None, None)], "doc_id long, text string, item_id string, cosine int")
    kept = {r.doc_id for r in decontaminate.decontaminate(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {900, 901} <= kept and len({i for i, _ in docs} - kept) >= 0.95 * len(leaks)
    assert {i for i, _ in docs} - kept <= {i for i, _ in leaks}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(df, nothing).count() == df.count()
    assert decontaminate.find_leaks(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_chance_candidates_are_told_by_counts(spark, monkeypatch):
    """Texts of words of their own with one of a few phrases share signatures by chance, which are too few for a link; copies with one other word keep theirs."""
    rng = random.Random(11)
    phrases = [" ".join(f"p{k}x{i}" for i in range(6)) for k in range(20)]
    texts = []
    for d in range(200):
        words = [f"d{d}w{rng.randrange(10**6)}" for _ in range(rng.randrange(90, 140))]
        at = rng.randrange(len(words))
        texts.append(" ".join([*words[:at], phrases[d % 20], *words[at:]]))
    copies = []
    for text in texts[:10]:
        words = text.split()
        words[rng.randrange(len(words))] = "other"
        copies.append(" ".join(words))
    seen, real = [], jaccard_join._near_stars
    monkeypatch.setattr(jaccard_join, "_near_stars", lambda stars, *a, **k: seen.append(stars.select("u").distinct().count()) or real(stars, *a, **k))
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {d: d - 200 if d >= 200 else d for d in range(210)}
    assert 20 <= seen[0] <= 30


def test_most_sets_have_no_more_empty_blocks_than_spare_ones():
    """Empty blocks of a set that has more would be signatures, and those of a size band would share them."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(60, 600, 400)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 1 << 63, ptr[-1], dtype=np.int64).view(np.uint64)
    sig, *_ = jaccard_join._signatures(h, ptr, 80, 100, jaccard_join._bands(80, 100))
    # random sets share a signature only if it is of an empty block
    assert len(sig) - len(np.unique(sig)) < 0.01 * len(sig)
