"""Line dedup by content-defined chunks, with DataFrame functions only.

The lines of a text are hashed, and a rolling hash runs over the last ``window`` line hashes. A chunk
ends where that hash is larger than at both neighbouring lines, so boundaries depend on a few nearby lines
only, shift with them, and are never one line apart. A line of ``long_words`` words or more
stands alone. A chunk of two lines or more, or of one such long line, that occurs more than once in all
documents stays at its first place (smallest doc_id, then position) and is removed elsewhere,
after its bytes were compared.

A repeated passage need not hold a whole chunk in both documents, since its outer lines merge with foreign ones. So
every two neighbouring lines are also a pair, pairs that occur more than once are compared by their bytes, and
unbroken runs of pairs that have an earlier place are removed if they hold ``long_words`` words or more. What a run
holds depends on no line outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import beside, cut

BROADCAST_ROWS = 1_000_000
STEP, MODULUS = 1009, 1_000_003


def _chunked(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """docs(doc_id, text) with key, lines and ends: the last line of each chunk, counted from 0."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), F.split("text", "\n", -1).alias("lines")).where("lines is not null")
    hashed = lines.select(
        "*",
        F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")).alias("v"),
        F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= long_words - 1).alias("long"),
    )
    last = "size(lines) - 1"
    rolling = " + ".join(f"if(i >= {k}, v[greatest(i - {k}, 0)], 0) * {STEP**k}" for k in range(window))
    rolled = hashed.select("*", F.expr(f"transform(sequence(0, {last}), i -> ({rolling}) % {MODULUS})").alias("r"))
    peak = f"i > 0 and i < {last} - 1 and r[i] > r[greatest(i - 1, 0)] and r[i] >= r[least(i + 1, {last})]"
    ends = f"filter(sequence(0, {last}), i -> i = {last} or `long`[i] or `long`[least(i + 1, {last})] or ({peak}))"
    return rolled.select("doc_id", "key", "lines", "long", F.expr(ends).alias("ends"))


def _slices(wanted: str) -> Column:
    """Chunks as structs (start, stop, chunk) of the places k of ``ends`` that ``wanted`` admits."""
    start = "if(k = 0, 0, ends[greatest(k - 1, 0)] + 1)"
    return F.expr(
        f"transform(filter(transform(ends, (e, k) -> named_struct('start', {start}, 'stop', e)), c -> {wanted}), "
        "c -> named_struct('start', c.start, 'stop', c.stop, 'chunk', array_join(slice(lines, c.start + 1, c.stop - c.start + 1), '\\n')))"
    )


def _pairs(wanted: str) -> Column:
    """Structs (start, words, last, pair) of the neighbouring lines start and start + 1 that ``wanted`` admits; words of the first, and of the second line."""
    words = "if({0} = '', 0, length({0}) - length(replace({0}, ' ', '')) + 1)"
    return F.expr(
        f"transform(filter(sequence(0, size(lines) - 2), i -> {wanted}), i -> named_struct('start', i, 'words', {words.format('lines[i]')}, "
        f"'last', {words.format('lines[i + 1]')}, 'pair', concat(lines[i], '\n', lines[i + 1])))"
    )


def _hash(value: str) -> Column:
    return F.xxhash64(value)


def _with_keeper(texts: DataFrame, value: str) -> DataFrame:
    """texts(doc_id, key, start, value, ...) whose value occurs more than once, with keeper, the first place of its bytes.

    Values of equal hashes are compared by their bytes: where the least and the largest are the same, all are, and the
    hash stands for them. Hashes of several values, if there are any, are grouped and joined with the bytes beside them.
    Groups are added up before the shuffle, and the keepers are a written table, so a value of very many places
    is never in one task.
    """
    hashed = texts.withColumn("h", _hash(value))
    place = F.min(F.struct("doc_id", "key", "start")).alias("keeper")
    groups = hashed.groupBy("h").agg((F.min(value) == F.max(value)).alias("same"), place, F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select("h", "same", "keeper"))
    found = beside(hashed, groups.where("same").select("h", "keeper"), "h")
    mixed = groups.where("not same").select("h")
    if not mixed.isEmpty():
        several = beside(hashed, mixed, "h")
        first = cut(several.groupBy("h", value).agg(place, F.count("*").alias("n")).where("n > 1").drop("n"))
        found = found.unionByName(several.join(first, ["h", value]), allowMissingColumns=False)
    return found


def _passages(core: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, key, start, stop) of runs of repeated pairs, but for each pair's first place."""
    lines = core.select("doc_id", F.xxhash64("text").alias("key"), F.split("text", "\n", -1).alias("lines")).where("size(lines) > 1")
    hashes = F.expr("transform(sequence(0, size(lines) - 2), i -> xxhash64(lines[i], lines[i + 1]))")
    keys = cut(lines.select("doc_id", "key", F.posexplode(hashes).alias("start", "h")))
    repeated = cut(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    places = cut(beside(keys, repeated, "h").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts")))
    few = places.count() <= BROADCAST_ROWS and keys.count() <= 8 * BROADCAST_ROWS
    found = _beside(lines, places, "starts", few, "inner")
    texts = found.select("doc_id", "key", F.explode(_pairs("array_contains(__starts, i)")).alias("c")).select("doc_id", "key", "c.*")
    # a line that follows itself doesn't take a line from its pair's first place
    own = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key")) & (F.col("start") < F.col("keeper.start") + 2)
    gone = _with_keeper(texts, "pair").where(~own).select("doc_id", "key", "start", "words", "last").distinct()
    runs = gone.withColumn("run", F.col("start") - F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("start"))).groupBy("doc_id", "key", "run")
    runs = runs.agg(F.min("start").alias("start"), (F.max("start") + 1).alias("stop"), (F.sum("words") + F.max_by("last", "start")).alias("words"))
    return runs.where(F.col("words") >= long_words).select("doc_id", "key", "start", "stop")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges (doc_id, key, start, stop) of lines, those that overlap made one."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.distinct().withColumn("head", (before.isNull() | (F.col("start") > before)).cast("int"))
    return apart.withColumn("n", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "key", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("n")


def line_dedup(docs: DataFrame, window: int = 2, long_words: int = 50, passages: bool = True) -> DataFrame:
    """docs with repeated chunks and passages cut out of text, and n_lines, removed_lines, removed (start, stop of cuts).

    passages: whether runs of repeated pairs go, too; without, only whole chunks do.
    A null text stays null with 0 lines; a text without removals is returned byte by byte. Chunks
    without any character but line ends are kept. Rows of the same doc_id and text count as one place,
    so that repeated rows come out alike. Other columns of docs pass through.
    """
    core = docs.select("doc_id", "text")
    chunked = _chunked(core, window, long_words)
    eligible = "(c.stop > c.start or `long`[c.start])"
    keys = chunked.select("doc_id", "key", F.explode(_slices(eligible)).alias("c")).select(
        "doc_id", "key", F.col("c.start").alias("start"), F.xxhash64("c.chunk").alias("h"), (F.length("c.chunk") > F.col("c.stop") - F.col("c.start")).alias("said")
    )
    keys = cut(keys.where("said").drop("said"))
    repeated = cut(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    places = cut(beside(keys, repeated, "h").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts")))
    few = places.count() <= BROADCAST_ROWS and keys.count() <= 8 * BROADCAST_ROWS  # 8 bytes a start, 40 a document
    found = _beside(chunked, places, "starts", few, "inner")
    texts = found.select("doc_id", "key", F.explode(_slices(f"{eligible} and array_contains(__starts, c.start)")).alias("c")).select(
        "doc_id", "key", "c.start", "c.stop", "c.chunk"
    )
    gone = _with_keeper(texts, "chunk").where(~F.struct("doc_id", "key", "start").eqNullSafe(F.col("keeper")))
    if passages:
        gone = _merged(gone.select("doc_id", "key", "start", "stop").unionByName(_passages(core, long_words)))
    gone = cut(gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed")))
    few = few and gone.count() <= BROADCAST_ROWS
    docs = docs.drop("n_lines", "removed_lines", "removed")
    out = _beside(docs.withColumn("__key", F.xxhash64("text")), gone, "removed", few, "left", "__key").withColumn("__lines", F.split("text", "\n", -1))
    kept = F.expr("array_join(filter(__lines, (x, i) -> not exists(__removed, c -> i between c.start and c.stop)), '\\n')")
    total = F.expr("coalesce(aggregate(__removed, 0, (s, c) -> s + c.stop - c.start + 1), 0)")
    return out.select(
        *[F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"), total.alias("removed_lines"), F.coalesce("__removed", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("removed"),
    )


def _beside(rows: DataFrame, side: DataFrame, value: str, few: bool, how: str, key: str = "key") -> DataFrame:
    """rows joined to side(doc_id, key, value), whose columns get names that no table has."""
    side = side.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col(value).alias(f"__{value}"))
    return rows.join(F.broadcast(side) if few else side, [F.col("doc_id").eqNullSafe(F.col("__d")), F.col(key) == F.col("__k")], how)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the rule of OP9_SQL, which has chunks only
    return line_dedup(docs, passages=False).select("doc_id", "text", "n_lines", "removed_lines", F.size("removed").alias("removed_chunks"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
v AS (SELECT *, ('0x' || substr(md5(x), 1, 7))::BIGINT AS v, length(x) - length(replace(x, ' ', '')) >= 49 AS long FROM l),
r AS (SELECT *, (v + coalesce(lag(v) OVER d, 0) * 1009) % 1000003 AS r, count(*) OVER (PARTITION BY doc_id) - 1 AS last FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT *, long OR coalesce(lead(long) OVER d, true) OR (i > 0 AND i < last - 1 AND r > lag(r) OVER d AND r >= lead(r) OVER d) AS ends FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w),
c AS (SELECT doc_id, k, min(i) AS start, count(*) AS lines, bool_or(long) AS long, string_agg(x, chr(10) ORDER BY i) AS chunk FROM n GROUP BY doc_id, k),
g AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) AS nth FROM c WHERE (lines > 1 OR long) AND length(chunk) > lines - 1),
m AS (SELECT c.*, coalesce(g.nth, 1) > 1 AS gone FROM c LEFT JOIN g USING (doc_id, k))
SELECT d.doc_id, coalesce(t, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(removed_lines, 0)::INTEGER AS removed_lines, coalesce(removed_chunks, 0)::INTEGER AS removed_chunks
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS t, sum(lines) AS n_lines, sum(lines) FILTER (gone) AS removed_lines, count(*) FILTER (gone) AS removed_chunks
  FROM m GROUP BY doc_id) USING (doc_id)
"""
