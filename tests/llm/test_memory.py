"""What tasks of the pipeline hold beside the texts, by numpy's own count."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate, jaccard_join, text, toxicity


def _texts(n: int, words: int) -> pa.Array:
    rng = np.random.default_rng(7)
    return pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, words)) for _ in range(n)])


def _peak_mb(work) -> float:
    text._powers.clear()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sets_of_a_large_batch_are_made_in_small_pieces():
    texts = _texts(2000, 300)  # 4 MB

    def work():
        for _ in jaccard_join._sets(texts, 5):
            pass

    assert _peak_mb(work) < 30


def test_fit_of_toxicity_holds_used_grams_only():
    texts = _texts(2000, 300)
    table = pa.table({"doc_id": np.arange(2000), "text": texts, "label": np.arange(2000) % 2})
    assert _peak_mb(lambda: toxicity._fit(table, 0.5)) < 130


def test_items_have_rows_of_their_own_words_only():
    space = np.random.default_rng(3).normal(size=(decontaminate.FEATURES, 8)).astype(np.float32)
    weight = np.ones(decontaminate.FEATURES, np.float32)
    own = pa.array(["one two three four five six seven", "eight nine"], pa.large_string())
    items = decontaminate.Items([1, 2], own, weight, space, 3)
    assert items.space.shape == (9, 8)
    words, _ = decontaminate.plain_words(*text.arrow_bytes(own.slice(0, 1)))
    assert (items.space[items.row[decontaminate.feature(words)]] == space[decontaminate.feature(words)]).all()
    # the texts' leaks are found by these rows
    words, ptr = decontaminate.plain_words(*text.arrow_bytes(pa.array(["x y one two three four five six seven z", "eight nine", "a b c d e f g"])))
    found = decontaminate._leaks(items, words, ptr, **decontaminate.SETTINGS)
    assert list(zip(found[0].tolist(), found[1].tolist(), strict=True)) == [(0, 0), (1, 1)]
