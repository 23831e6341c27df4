"""Three-valued aggregates: "zero" and "unknown" are kept apart.

A sum over rows that state nothing is null, a count of nothing is 0, and a distinct count over rows that
never state the field is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def among(condition: Column, value: Column | str) -> Column:
    """value where condition holds, else null: the argument of a filtered aggregate."""
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def count_of(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_known(condition: Column, value: str) -> Column:
    """Sum of the stated values, null if none is stated."""
    return F.sum(among(condition, value))


def sum_complete(condition: Column, value: str) -> Column:
    """Sum only if every row in scope states the value."""
    return F.when(count_of(condition) == F.count(among(condition, value)), sum_known(condition, value))


def coverage(condition: Column, value: str) -> Column:
    """observed, partial or unavailable, by how many rows in scope state the value."""
    scope, stated = count_of(condition), F.count(among(condition, value))
    return F.when(stated == 0, "unavailable").when(stated < scope, "partial").otherwise("observed")


def distinct_three(condition: Column, value: str) -> Column:
    """0 without rows, null if rows never state the value, else the distinct count."""
    return F.when(count_of(condition) == 0, F.lit(0)).otherwise(F.nullif(F.countDistinct(among(condition, value)), F.lit(0))).cast("long")


def all_known(condition: Column, value: str | Column, result: Column) -> Column:
    """result, but null if any row in scope leaves value unknown."""
    return F.when(count_of(condition) == F.count(among(condition, value)), result)


def ratio(a: Column, b: Column) -> Column:
    """a/b, null if b is 0 or either is unknown."""
    return F.try_divide(a.cast("double"), b.cast("double"))


#: rank orders of coverage words; the two layers rank them differently
REDUCER_RANK = ("observed", "partial", "derived", "unavailable")
SERIES_RANK = ("observed", "derived", "partial", "unavailable")


def _rank(word: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.lit(list(order)), word)


def best_coverage(word: Column, order: tuple[str, ...] = REDUCER_RANK) -> Column:
    return F.element_at(F.lit(list(order)), F.min(_rank(word, order)).cast("int"))


def weakest_coverage(word: Column, order: tuple[str, ...] = SERIES_RANK) -> Column:
    return F.element_at(F.lit(list(order)), F.max(_rank(word, order)).cast("int"))
