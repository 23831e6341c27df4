"""Costly rows are dealt to many tasks, and what follows from one column is worked out once for each value."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators import joins
from tidemark.plans import catalog


@pytest.mark.parametrize("name", ["clean_kinds", "clean_json", "normal_forms", "mixed_surfaces"])
def test_costly_rows_are_dealt_to_many_tasks(spark, name):
    """The tables are files of one row group, which is one task as it is read."""
    assert catalog.queries()[name](spark, SF).rdd.getNumPartitions() >= 64


@pytest.mark.parametrize("limit", [400_000, 0])
def test_once_each_keeps_all_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    rows = [(i, [None, "a", "b", "", "a b"][i % 5]) for i in range(40)] + [(3, "a")]
    df = joins.once_each(spark.createDataFrame(rows, "id long, t string"), "t", {"n": F.length("__of"), "null": F.col("__of").isNull()})
    assert sorted((r.id, r.t or "", r.n, r.null) for r in df.collect()) == sorted((((i, t or "", None if t is None else len(t), t is None)) for i, t in rows), key=lambda x: x[:2])
