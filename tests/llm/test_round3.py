"""Importance resampling, spelling variants and language identification: brute force, edge cases and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.llm import language_id, resampling, variants

SCHEMA = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


# importance resampling


def resampled_brute(rows, target, percent, least, most, buckets, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        n, fs = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    full = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(full[: len(full) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = vocabulary(rng, 300) + ["Été", "zwölf", "日本", "naïve9", "0x1f"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", ", ", "\n", "--", " "]) for _ in range(n))
    rows = [(i, make(rng.randint(0, 90))) for i in range(250)] + [(900 + i, "the same words again and again, " * 8) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " .,; "), (None, make(40)), (None, None), (2003, make(30_000)), (7, rows[7][1]), (7, rows[7][1]), (8, "another text of one id")]
    return rows, [make(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("most", "percent", "buckets"), [(1, 10, 10_000), (2, 35, 500), (3, 100, 77)])
def test_resampling_equals_brute_force(spark, texts, most, percent, buckets):
    rows, target = texts
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", weight string, rank int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, wanted, percent=percent, most=most, buckets=buckets).collect()
    want = resampled_brute(rows, target, percent, 20, most, buckets, 2024)
    # rows of one id and score may take each other's places
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r[4] is not None for r in want)))


def test_resampling_of_small_chunks_and_empty_tables(spark, texts):
    rows, target = texts
    docs, wanted = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    whole = sorted(map(str, resampling.resample(docs, wanted).collect()))
    assert sorted(map(str, resampling.resample(docs.repartition(3), wanted, size=2000).collect())) == whole
    assert resampling.resample(docs.limit(0), wanted).count() == 0
    assert resampling.resample(docs, wanted.limit(0)).where("weight > 0").count() >= 0
    with_none = resampling.resample(docs, wanted.limit(0), percent=0)
    assert with_none.count() == len(rows) and with_none.where("rank is not null").count() == 0


def test_a_word_of_every_document_is_a_row_for_each_chunk(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("common common word").alias("text")).coalesce(2)
    chunks = resampling.chunked(docs)
    assert chunks.where("feature = 'common'").agg(F.sum("n")).first()[0] == 6000
    assert chunks.where("feature is not null").count() == 2 * chunks.where("ids is not null").count()


# language identification


def symbols_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode()).lstrip(b" ")


def phrases_brute(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_a_search_for_the_longest_match(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(language_id, "PIECE", 37)
    parsers, samples = [], []
    for letters, n in (("abcd", 900), ("abcé", 700), ("x", 3), ("ab ", 0)):
        sample = "".join(rng.choice(letters + " ") for _ in range(n))
        table = pa.table({"lang": ["l"], "docs": [1], "h": [1], "piece": [sample]})
        row = {k: v[0] for k, v in language_id._fit(table, 1 << 20).to_pydict().items()}
        samples.append(symbols_brute(sample))
        assert row["n"] == len(samples[-1])
        parsers.append(language_id.Parser(row))
    texts = ["".join(rng.choice("abcdé x.7Q ") for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["", None, "  ", "a", "é", ". a", "zzzz", "a" * 5000]
    data, offsets = next((d, o) for _, _, d, o in language_id.slices(pa.array(texts), 1 << 30))
    flat, ptr = language_id.symbols(data, offsets)
    want = [symbols_brute(t) for t in texts]
    assert [flat[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == want
    for keep in (9, 0):
        got = language_id.parse(data, offsets, parsers, keep)
        assert got.tolist() == [[sum(phrases_brute(t[a : a + 37], s) for a in range(0, len(t), 37)) for s in samples] for t in want]


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(1)
    stems = {k: vocabulary(rng, 60, letters) for k, letters in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklabñé", "dd": "добрый"}.items()}
    make = lambda k, n: " ".join(rng.choice(stems[k]) for _ in range(n))
    rows = [(i, make(k, rng.randint(3, 60)), k) for i in range(240) for k in [rng.choice(list(stems))]]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 .. !?", "cc"), (1003, make("bb", 30_000), "bb"), (None, make("dd", 20), "dd"), (1004, make("aa", 20), None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return rows + odd


def test_languages_of_held_out_texts(spark, tongues, monkeypatch):
    docs = spark.createDataFrame([(*r, "clash", 1.5) for r in tongues], SCHEMA + ", lang string, lang_pred string, odds double").repartition(4)
    model = language_id.fit_languages(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2))
    assert sorted(r["lang"] for r in model.collect()) == ["aa", "bb", "cc", "dd"]
    got = language_id.identify(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == len(tongues)
    rows = got.collect()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert all(by[i] == {("und", 0.0)} for i in (1000, 1001, 1002)) and len(by[3]) == 1
    true = [(i, k) for i, t, k in tongues if t and k and re.search("[^\\W\\d]", t)]
    assert sum(any(p == k for p, _ in by[i]) for i, k in true) >= 0.97 * len(true)
    # languages in blocks of one give the same
    monkeypatch.setattr(language_id, "BLOCK", 1)
    again = language_id.identify(docs, model).collect()
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 9))
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_no_labels_and_no_rows(spark, tongues):
    docs = spark.createDataFrame(tongues, SCHEMA + ", lang string")
    none = language_id.fit_languages(docs.where("lang is null"))
    assert none.count() == 0 and {tuple(r) for r in language_id.identify(docs, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), language_id.fit_languages(docs)).count() == 0


def test_sample_of_a_language_is_bounded_and_counts_copies_once(spark, tongues):
    docs = spark.createDataFrame(tongues * 3, SCHEMA + ", lang string")
    small = {r["lang"]: r for r in language_id.fit_languages(docs, rows=10, chars=50, most=300).collect()}
    assert all(0 < r["n"] <= 300 for r in small.values())
    assert sum(r["docs"] for r in small.values()) == 3 * sum(t is not None and k is not None for _, t, k in tongues)
    once = spark.createDataFrame(tongues, SCHEMA + ", lang string")
    assert {r["lang"]: r["n"] for r in language_id.fit_languages(once).collect()} == {r["lang"]: r["n"] for r in language_id.fit_languages(docs).collect()}


def test_language_query_on_held_out_documents(spark):
    from tidemark.llm import registry

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.queries()["op13_language_id"](spark, SF)
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert rows[0] >= 0.95 and rows[1] > 20


# spelling variants


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def variants_brute(rows, least_letters=5, least_count=3):
    n = Counter()
    for i, t in rows:
        for r in re.findall("[a-z\u00c0-\u00ff]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_letters and k >= least_count}
    letters = sorted({c for w in n for c in w})
    near = {w: {v for v in edits(w, letters) if v in n and v != w} for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_wavelet_tree_reports_all_points_of_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 100, 257):
        values = rng.permutation(n)
        tree = variants.WaveletTree(values)
        left, low = rng.integers(0, n, 60), rng.integers(0, n, 60)
        right, high = np.minimum(n, left + rng.integers(0, n + 1, 60)), np.minimum(n, low + rng.integers(0, n + 1, 60))
        query, value = tree.report(left, right, low, high)
        got = sorted(zip(query.tolist(), value.tolist(), strict=True))
        assert got == sorted((q, int(v)) for q in range(60) for v in values[left[q] : right[q]] if low[q] <= v < high[q])


def test_near_pairs_of_one_range_of_places():
    rng = random.Random(4)
    for n in (1, 5, 6):
        words = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.choice([n, n - 1]))) for _ in range(150)} - {b""})
        for a, b in ((0, n), (0, n // 2), (n // 2, n)):
            u, v = variants.near_pairs(words, n, a, b)
            got = sorted(zip(u.tolist(), v.tolist(), strict=True))
            want = []
            for i, x in enumerate(words):
                for j, y in enumerate(words):
                    x_, y_ = (x, y) if len(x) >= len(y) else (y, x)
                    if i == j or len(x_) != n:
                        continue
                    k = next((k for k in range(len(y_)) if x_[k] != y_[k]), len(y_))
                    same = x_[k + 1 :] == y_[k + (len(x_) == len(y_)) :]
                    if same and len(x_) != len(y_):  # the first place where the letter may stand
                        while k and x_[k - 1] == x_[k]:
                            k -= 1
                    if same and a <= k < b:
                        want.append((i, j))
            assert got == want and len(set(got)) == len(got)


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé\u00ffz") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab"]
    stems += ["x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, "Prefixedword" + "é" * 5]

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.4 and len(w) < 100:
            w = rng.choice(list(edits(w, "abz")))
        return w.upper().replace("É", "é") if rng.random() < 0.2 and w.isascii() else w

    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "12 - _ 日本語 ."), (None, "aaaaab aaaaab"), (3, rows[3][1]), (3, rows[3][1]), (600, "commonword " * 20_000 + "commonwords " * 300 + "comonword " * 7)]


@pytest.mark.parametrize(("task_words", "group_words"), [(20_000, 5_000), (7, 3), (50, 1)])
def test_variants_equal_brute_force(spark, spelt, task_words, group_words):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in spelt], SCHEMA + ", word string, n int").repartition(4)
    got = variants.variants(docs, task_words=task_words, group_words=group_words)
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == variants_brute(spelt)


def test_variants_of_nothing_and_of_words_that_share_all_letters_but_one(spark):
    none = spark.createDataFrame([(1, None), (2, "short wrds one")], SCHEMA)
    assert variants.variants(none).count() == 0 and variants.variants(none.limit(0)).count() == 0
    # every word in one group by its first half: dealt again until a place is left
    words = [f"{'a' * 12}{x}{y}{z}" for x in "bcdefghijk" for y in "bcdefghij" for z in "bcdef"]
    rows = [(i, " ".join([w] * (3 + i % 7))) for i, w in enumerate(words)]
    got = variants.variants(spark.createDataFrame(rows, SCHEMA), group_words=20)
    assert sorted(tuple(r) for r in got.collect()) == variants_brute(rows)


def test_chain_of_forms_is_followed_to_its_end(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [(f"v{i}", "w000") for i in range(500)]
    from tidemark.llm.graph import cut

    got = variants.roots(cut(spark.createDataFrame(chain, "word string, form string")))
    assert got.count() == len(chain) and {r.root for r in got.collect()} == {"w037"}


# hot keys


def test_one_chunk_and_one_text_in_most_rows(spark):
    """A text with thousands of copies and a chunk that most documents have, with joins that are shuffled and split."""
    from tidemark.llm import jaccard_join, line_dedup

    lines = "first shared line of all\nsecond shared line of all"
    rows = [(i, "one text of very many exact copies in this table") for i in range(3000)] + [(10_000 + i, lines if i % 2 else f"{' '.join(f'w{i}x{k}' for k in range(50))}\n{lines}") for i in range(1500)]
    rows += [(20_000 + i, f"an unlike text number {i} about {i * 7} and {i * 11} things") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r for r in jaccard_join.jaccard_components(docs).collect()}
        out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(found[i].component_id == 0 and found[i].class_size == 3000 for i in range(3000))
    assert all(found[20_000 + i].component_id == 20_000 + i for i in range(50))
    assert out == {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()} and len(out) == len(rows)
    assert sum(lines in r.text for r in out.values()) == 1


def test_leaks_with_many_fitting_tasks_and_several_passes(spark, monkeypatch):
    """Matrices added up in a tree, and blocks of items in passes, find what two tasks and one block do; also null ids and repeated rows."""
    from tidemark.llm import decontaminate

    rng = random.Random(12)
    vocab = vocabulary(rng, 900, "abcdefghijklm")
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(30)) for i in range(50)]
    docs = [(i, make(120)) for i in range(60)] + [(100 + i, f"{make(50)} {t} {make(50)}") for i, t in items] + [(None, items[3][1]), (None, None), (7, items[4][1]), (7, items[4][1])]
    df, bench = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda rows: sorted(((r.doc_id, r.item_id) for r in rows.collect()), key=str)
    want = pairs(decontaminate.find_leaks(df, bench))
    assert want == sorted([(100 + i, i) for i in range(50)] + [(None, 3), (7, 4), (7, 4)], key=str)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    monkeypatch.setattr(decontaminate, "HELD_BLOCKS", 2)
    monkeypatch.setattr(decontaminate, "FAN", 3)
    assert pairs(decontaminate.find_leaks(df, bench, fit_rows=60, fit_docs=100)) == want
    left = decontaminate.decontaminate(df, bench, fit_rows=60, fit_docs=100)
    assert sorted((str(r.doc_id) for r in left.collect())) == sorted([str(i) for i in range(60) if i != 7] + ["7", "None"])
