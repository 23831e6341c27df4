"""Language identification by cross-parsing entropy with suffix automata.

Of each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed against it from
left to right: a phrase is the longest match with any place of the sample, or one symbol that the sample
doesn't have, and the next phrase begins behind it. With c phrases and a sample of N symbols the text costs c log2(N) bits in that
language; the one with the fewest bits wins, of equal ones that with more labelled documents, then the first by name.

Symbols are bytes of the lower-cased text in which what is neither an ASCII letter nor beyond ASCII is one space. Texts are parsed
in pieces of ``PIECE`` symbols, at the end of which a phrase ends too, so that very long texts are parsed in as many lanes as they have pieces:
all pieces of a chunk of texts advance together, symbol by symbol, through one table of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dealing import pack, unpack_one
from .graph import beside, cut
from .text import LOWER, slices
from .toxicity import fold

SAMPLE_ROWS = 400  # texts of a language to learn from
SAMPLE_CHARS = 1000  # of each text, from a place that its hash chooses
SAMPLE_BYTES = 1 << 17  # symbols of a language's automaton
PIECE = 1024
CHUNK = 4 << 20
BLOCK = 64  # languages that are broadcast together, at most about 4 MB each
TABLES = 8  # tables of transitions that a worker keeps, about 30 MB each

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True

MODEL = "lang string, n int, docs long, states int, alphabet binary, edges int, state binary, symbol binary, target binary"


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as symbols with pointers: letters, and one space behind each run of them."""
    low = LOWER[data]
    letter = LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(low)]
    keep[heads] = letter[heads]
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(letter, low, np.uint8(32))[keep], at[offsets]


def suffix_automaton(text: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton of all substrings; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


def _fit(rows: pa.Table, most: int) -> pa.Table:
    """A language's automaton, as packed lists of its transitions."""
    rows = rows.sort_by([("h", "ascending"), ("piece", "ascending")])
    data, offsets = next(((d, o) for _, _, d, o in slices(rows.column("piece").combine_chunks(), 1 << 40)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    text = symbols(data, offsets)[0][:most]
    seen = np.unique(text)
    alphabet = np.full(256, len(seen), np.uint8)
    alphabet[seen] = np.arange(len(seen))
    moves = suffix_automaton(alphabet[text].tolist())
    flat = np.array([(s, c, t) for s, own in enumerate(moves) for c, t in own.items()], np.int64).reshape(-1, 3)
    return pa.table({
        "lang": rows.column("lang")[:1], "n": pa.array([len(text)], pa.int32()), "docs": rows.column("docs")[:1], "states": pa.array([len(moves)], pa.int32()), "alphabet": pa.array([alphabet.tobytes()]),
        "edges": pa.array([len(flat)], pa.int32()), "state": pa.array([pack(np.diff(flat[:, 0], prepend=0).astype(np.uint32))]), "symbol": pa.array([pack(flat[:, 1].astype(np.uint8))]), "target": pa.array([pack(flat[:, 2].astype(np.uint32))]),
    })


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, most: int = SAMPLE_BYTES) -> DataFrame:
    """A written table of MODEL with a row for each language of docs(text, lang); null languages and texts are left out.

    The sample: of a language's distinct texts those with the ``rows`` smallest hashes, of each ``chars`` characters from a place
    that the hash chooses, and of these the first ``most`` symbols. docs counts all labelled rows.
    """
    own = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    sizes = cut(own.groupBy("lang").agg(F.count("*").alias("docs"), F.approx_count_distinct("h").alias("texts")))
    share = F.col("texts").cast("double") / (4.0 * rows)  # about four times as many as wanted pass, if there are more
    near = beside(own, sizes, "lang").where(F.pmod("h", F.lit(1 << 31)) * share < (1 << 31))
    start = F.pmod(F.shiftrightunsigned("h", 16), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    pieces = near.select("lang", "docs", "h", F.lower(F.substring(F.col("text"), start, F.lit(chars))).alias("piece")).distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "piece")
    some = pieces.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).drop("k")
    return cut(some.groupBy("lang").applyInArrow(lambda t: _fit(t, most), MODEL))


class Parser:
    """One language: counts the phrases of pieces."""

    def __init__(self, row: dict) -> None:
        self.lang, self.docs, self.bits = row["lang"], row["docs"], float(np.log2(max(2, row["n"])))
        self.row, self.table = row, None

    def _filled(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Transitions of all states on all symbols; the two low bits count the phrases that end on the way."""
        row, m = self.row, self.row["edges"]
        alphabet = np.frombuffer(row["alphabet"], np.uint8)
        width = -(-(int(alphabet.max()) + 1) // 4) * 4
        state, symbol, target = (unpack_one(row[c], m, k).astype(np.int64) for c, k in (("state", np.uint32), ("symbol", np.uint8), ("target", np.uint32)))
        state = np.cumsum(state)
        first = np.full(width, 1, np.int64)  # from the root: an unknown symbol is a phrase
        own = state == 0
        first[symbol[own]] = target[own] * width
        again = np.where(first == 1, 2, first + 1)  # from elsewhere: the phrase before ends, too
        table = np.tile(again.astype(np.int32), row["states"])
        table[:width] = first
        table[state * width + symbol] = target * width
        return table, alphabet, width

    def phrases(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, active: np.ndarray, keep: bool) -> np.ndarray:
        """Phrases of the pieces at start, which are sorted by falling length; active: how many have more than t symbols, for each t."""
        table, alphabet, _ = self.table or self._filled()
        if keep and self.table is None:
            self.table = table, alphabet, _
        flat = alphabet[flat].astype(np.int32)
        state, found, at = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32), start.copy()
        for k in active.tolist():
            v = table.take(state[:k] + flat.take(at[:k]))
            found[:k] += v & 3
            state[:k] = v & -4
            at[:k] += 1
        return found + (state > 0)


def parse(data: np.ndarray, offsets: np.ndarray, parsers: list[Parser], keep: int = TABLES) -> np.ndarray:
    """Phrases of each text (row) in each language (column)."""
    flat, ptr = symbols(data, offsets)
    size = np.diff(ptr)
    pieces = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = ptr[:-1][text] + k * PIECE
    length = np.minimum(PIECE, ptr[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    start, length, text = start[order], length[order], text[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    out = np.zeros((len(size), len(parsers)), np.int64)
    for j, p in enumerate(parsers):
        np.add.at(out[:, j], text, p.phrases(flat, start, length, active, j < keep))
    return out


#: lang, bits and docs of the best language so far, and log2 of the sum of all languages' odds, relative to the best
STATE = "lang_pred string, bits double, docs long, odds double"


def _judge(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    parsers = [Parser(r) for r in held.value]
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text"), CHUNK):
            cost = parse(data, offsets, parsers) * np.array([p.bits for p in parsers])
            part = batch.slice(a, b - a)
            best, bits, docs, odds = (part.column(c).to_pylist() for c in ("lang_pred", "bits", "docs", "odds"))
            order = [(p.docs, p.lang) for p in parsers]
            for i, row in enumerate(cost.tolist()):
                j = min(range(len(row)), key=lambda x: (row[x], -order[x][0], order[x][1]))
                total = sum(2.0 ** max(-500.0, row[j] - x) for x in row)
                if best[i] is None or (row[j], -order[j][0], order[j][1]) < (bits[i], -docs[i], best[i]):
                    total += 0.0 if best[i] is None else odds[i] * 2.0 ** max(-500.0, row[j] - bits[i])
                    best[i], bits[i], docs[i], odds[i] = order[j][1], row[j], order[j][0], total
                else:
                    odds[i] += total * 2.0 ** max(-500.0, bits[i] - row[j])
            columns = {"lang_pred": pa.array(best, pa.string()), "bits": pa.array(bits, pa.float64()), "docs": pa.array(docs, pa.int64()), "odds": pa.array(odds, pa.float64())}
            yield pa.RecordBatch.from_arrays([columns.get(n, part.column(n)) for n in part.schema.names], part.schema.names)


def identify(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text).

    score: the best language's share of all languages' odds 2^-bits. Null texts, texts without a letter and all texts where no language
    could be learned are ``und`` with score 0. Repeated rows and null ids are judged each; other columns of docs are ignored; an
    empty table stays empty. Languages come in blocks of BLOCK, and the best so far goes from one to the next.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(letter, F.lower(F.col("text").cast("string"))).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STATE.split(", "))])
    kind = dict(docs.dtypes)["doc_id"]
    names = [r["lang"] for r in model.select("lang").orderBy("lang").toLocalIterator()]
    for a in range(0, len(names), BLOCK):
        block = [r.asDict() for r in model.where(F.col("lang").isin(names[a : a + BLOCK])).orderBy("lang").collect()]
        held = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(partial(_judge, held=held), f"doc_id {kind}, text string, {STATE}")
    known = F.col("text").isNotNull() & F.col("lang_pred").isNotNull()
    return rows.select("doc_id", F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, 1.0 / F.col("odds")).otherwise(0.0).alias("score"))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
