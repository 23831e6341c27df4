"""Spelling variants: words that differ by one letter, found by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced letter makes one of the other. Words of one length n, with
those of length n - 1, are sorted forwards and backwards: each is a point with two ranks. For each place of an edit, the words
with the same letters before it are an interval of the forward order and those with the same letters behind it an interval
of the backward order. A wavelet tree over the backward ranks in forward order reports the points that lie in both.

Words are dealt by length, a range of places and the letters outside the range, which near words share: first the two halves. Groups of
too many words are dealt again by the halves of their range, at last by single places, where a group has no more words than there are
letters. So no word list is held whole, and each pair is found once, at the first place where its words part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import beside, cut

#: fixed values: letters of words; A-Z are lower-cased, all of them have one byte in Latin-1
RUN = "[a-zÀ-ÿ]+"
TASK_WORDS = 20_000  # words of a task
GROUP_WORDS = 5_000  # words of a group that isn't dealt again
TASK_BYTES = 8 << 20  # letters of a task


class WaveletTree:
    """Reports the points of rectangles: values (a permutation) by position, level by level from the highest bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.bits = len(values), max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        now = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            count = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every point at positions left to right - 1 with values low to high - 1; all queries descend together."""
        query, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        left, right = left.astype(np.int64), right.astype(np.int64)
        for level, count, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            a, b = count[left], count[right]
            query = np.concatenate([query, query])
            value = np.concatenate([value, value | (1 << level)])
            left, right = np.concatenate([left - a, zeros + a]), np.concatenate([right - b, zeros + b])
            keep = (left < right) & (value < high[query]) & (value + (1 << level) > low[query])
            query, value, left, right = query[keep], value[keep], left[keep], right[keep]
        return query, value


def _shared(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first letters each row of a sorted matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(letters), np.int64)
    step = max(1, (4 << 20) // max(1, letters.shape[1]))
    for a in range(1, len(letters), step):
        b = min(len(letters), a + step)
        differ = letters[a:b] != letters[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), letters.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def near_pairs(words: list[bytes], length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of words of ``length`` and ``length`` - 1 letters that differ by an edit at the places first to last - 1 of the longer one; both ways, each once."""
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    orders, ranks, shared = [], [], []
    for way in (1, -1):
        made = np.array([w[::way] for w in words], f"S{length}")
        order = np.argsort(made, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        orders.append(order)
        ranks.append(rank)
        shared.append(_shared(made[order].view(np.uint8).reshape(n, length), size[order]))
    tree = WaveletTree(ranks[1][orders[0]])
    letters = np.array(words, f"S{length}").view(np.uint8).reshape(n, length)
    # the most letters that a word shares with any other, forwards and backwards: other places have no candidates
    most = [np.maximum(s, np.append(s[1:], 0))[r] for s, r in zip(shared, ranks, strict=True)]
    found = []
    for place in range(first, last):
        behind = length - 1 - place  # the same for a replaced letter in the longer and an inserted one in the shorter word
        ask = np.flatnonzero((most[0] >= place) & (most[1] >= behind))
        if not len(ask):
            continue
        ends = []
        for k, letters_ in ((0, place), (1, behind)):
            heads = np.append(np.flatnonzero(shared[k] < letters_) if letters_ else 0, n)
            heads[0] = 0
            at = np.searchsorted(heads, ranks[k][ask], "right")
            ends += [heads[at - 1], heads[at]]
        query, value = tree.report(*ends)
        u, v = ask[query], orders[1][value]
        longer = np.where(size[u] >= size[v], u, v)
        # a letter that repeats the one before could as well be inserted there
        once = (u != v) & ((size[u] == size[v]) | (place == 0) | (letters[longer, place] != letters[longer, max(0, place - 1)]))
        found.append((u[once], v[once]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _best(table: pa.Table) -> pa.Table:
    """A task's words with how many near words it has found, and the most frequent of them (ties: the first)."""
    names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    first = {k: table.column(k)[0].as_py() for k in ("length", "a", "b")}
    words = [w.encode("latin-1") for w in names]
    u, v = near_pairs(words, first["length"], first["a"], first["b"])
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, dtype=object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[v], -n[v], u))
    u, v = u[order], v[order]
    heads = np.flatnonzero(np.diff(u, prepend=-1))
    count = np.diff(np.append(heads, len(u)))
    top = v[heads]
    return pa.table({"word": pa.array([names[i] for i in u[heads].tolist()], pa.string()), "n_near": pa.array(count, pa.int64()), "form": pa.array([names[i] for i in top.tolist()], pa.string()), "form_n": pa.array(n[top], pa.int64())})


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, modulus: int = 97) -> DataFrame:
    """word, n of docs(doc_id, text), with every ``modulus``-th run (by its and its document's checksum) misspelt by a lost letter.

    Null texts have no runs; a null doc_id is an empty id.
    """
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut_ = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % modulus == 0, cut_).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(word, n, length, a, b) with key: a hash of the letters before a and from b on in the longer word's places."""
    back = F.when(F.length("word") == F.col("length"), F.col("b")).otherwise(F.col("b") - 1)
    return rows.withColumn("key", F.xxhash64("length", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), back + 1, F.length("word"))))


def near_words(words: DataFrame, task_words: int = TASK_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n_near, form, form_n of the words(word, n), a written table, that have near words: their number and the most frequent one."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length")
    half = F.floor((F.col("length") + 1) / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("length").alias("b")))
    todo = words.select("word", "n", lengths).select("word", "n", "length", F.explode(ranges).alias("r")).select("word", "n", "length", "r.a", "r.b")
    done = []
    while True:
        todo = cut(_dealt(todo))
        large = cut(todo.where("b - a > 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > group_words).select("key"))
        if large.isEmpty():
            done.append(todo)
            break
        done.append(beside(todo, large, "key", "left_anti").select(*todo.columns))
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))).alias("r")
        todo = beside(todo, large, "key").where("b - a > 1").select("word", "n", "length", halves).select("word", "n", "length", "r.a", "r.b")
    dealt = done[0]
    for more in done[1:]:
        dealt = dealt.unionByName(more)
    parts = cut(dealt.groupBy("length", "a", "b").agg(F.ceil(F.greatest(F.count("*") / task_words, F.sum("length") / TASK_BYTES)).cast("long").alias("parts")))
    dealt = beside(dealt, parts, ["length", "a", "b"]).withColumn("part", F.pmod("key", F.col("parts")))
    found = dealt.groupBy("length", "a", "b", "part").applyInArrow(lambda t: _best(t), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows word, form of forms, a written table: the last word that forms lead to. Each round doubles the steps."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(beside(now, cut(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, factor: int = 2, task_words: int = TASK_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs(doc_id, text) of ``least_letters`` letters and ``least_count`` occurrences.

    form: the near word of largest n (ties: the first by code points), if that is at least ``factor`` times the word's, else null.
    root: where forms lead to in the end, or the word itself. Repeated rows count each, and very long words are words like others;
    other columns of docs are ignored; without words the result is empty.
    """
    words = cut(word_counts(docs, least_letters, least_count))
    near = cut(near_words(words, task_words, group_words))
    both = words.join(near, "word", "left")
    has = F.col("form_n") >= factor * F.col("n")
    both = cut(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    led = roots(cut(both.where("form is not null").select("word", "form")))
    return both.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS r FROM documents),
each AS MATERIALIZED (SELECT doc_id, r, count(*) AS k FROM runs GROUP BY doc_id, r),
hashed AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(doc_id::VARCHAR || ':' || r), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, tab),
spelt AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
gaps AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS MATERIALIZED (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS g FROM gaps),
near AS MATERIALIZED (SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN w ON h.g = w.word UNION SELECT w.word, h.word, h.n FROM holes h JOIN w ON h.g = w.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS f, max(n) AS fn FROM near GROUP BY a),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN fn >= 2 * w.n THEN f END AS form, CASE WHEN fn >= 2 * w.n THEN fn END AS form_n FROM w LEFT JOIN best ON a = word),
led AS (SELECT word, word AS at FROM formed UNION SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.at WHERE f.form IS NOT NULL),
ends AS (SELECT led.word, led.at AS root FROM led JOIN formed f ON f.word = led.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""
