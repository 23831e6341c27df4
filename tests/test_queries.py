"""Every query of the library against its SQL on the smallest tables."""

import pytest

from tidemark.plans import catalog

from conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
