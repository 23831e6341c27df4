"""Which of several sources says something about a row: ranked tellings, fallbacks, sole identities, and what is still to be done."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import first_rows, timeline

Cols = Sequence[str]


def first_telling(rows: DataFrame, ident: str, tellings: Sequence[tuple[str, DataFrame]], name: str = "told_by") -> DataFrame:
    """rows with the name of the first of the tellings, tables with the same id column, that has its id; null for none.

    Ids are added up before they meet the rows, so an id that is told very often is one row.
    """
    all_ = None
    for rank, (word, told) in enumerate(tellings):
        one = told.select(F.col(ident), F.lit(word).alias("__word"), F.lit(rank).alias("__rank"))
        all_ = one if all_ is None else all_.unionByName(one)
    best = all_.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min_by("__word", "__rank").alias(name))
    return rows.join(best, ident, "left")


def attributed(rows: DataFrame, stated: Column, key: Cols, order: Cols, derived: Column, name: str = "session") -> DataFrame:
    """rows with what they state, else what the last row of their key before them stated, else what is derived."""
    rows = rows.withColumn("__stated", stated.cast("string"))
    learned = F.last("__stated", ignorenulls=True).over(timeline(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce("__stated", learned, derived.cast("string"))).drop("__stated")


def sole_identity(claims: DataFrame, key: Cols, identity: str) -> DataFrame:
    """(key, identity, claims): the one known identity of each key; two different ones are refused, and claims says how many there are."""
    g = claims.groupBy(*key).agg(F.min(identity).alias("__one"), F.count_distinct(identity).cast("int").alias("claims"))
    return g.select(*key, F.when(F.col("claims") == 1, F.col("__one")).alias("identity"), "claims")


def arms_side_by_side(rows: DataFrame, key: Cols, arm: Column, arms: Mapping[str, str]) -> DataFrame:
    """Rows of each key by arm, a column an arm; a key that an arm lacks has null there, and rows of no arm are left out.

    arms: column by arm. One grouped pass instead of a full outer join of two.
    """
    named = rows.withColumn("__arm", arm).where(F.col("__arm").isin(*arms))
    counts = {c: F.count_if(F.col("__arm") == a) for a, c in arms.items()}
    return named.groupBy(*key).agg(*(F.when(n > 0, n).alias(c) for c, n in counts.items()))


def first_known(sources: Mapping[str, Column]) -> tuple[Column, Column]:
    """The first known value of ranked sources, and the source's name."""
    named = None
    for word, value in sources.items():
        named = F.when(value.isNotNull(), F.lit(word)) if named is None else named.when(value.isNotNull(), F.lit(word))
    return F.coalesce(*sources.values()), named


def newest(rows: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """The last row of each key by the order's columns."""
    return first_rows(rows, list(key), [F.col(c).desc() for c in order])


def first_crossing(rows: DataFrame, key: Cols, order: Cols, amount: Column, bound: float, ident: str) -> DataFrame:
    """(key, crossed_at, holes): the first row at which the known amounts of a key pass a bound; null if an amount before it is unknown."""
    w = timeline(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"__sum": F.sum(amount).over(w), "__holes": F.count_if(amount.isNull()).over(w)})
    first = run.where(F.col("__sum") > bound).groupBy(*key).agg(F.min_by(F.struct(F.col(ident).alias("at"), F.col("__holes").alias("holes")), F.struct(*order)).alias("x"))
    return first.select(*key, F.when(F.col("x.holes") == 0, F.col("x.at")).alias("crossed_at"), F.col("x.holes").alias("holes"))


def todo(rows: DataFrame, is_new: Column, key: Cols, position: str, again: int = 3) -> DataFrame:
    """The new rows, and of the recorded ones the last ``again`` of each key, which are looked at again."""
    marked = rows.withColumn("__new", F.coalesce(is_new, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*key, "__new").orderBy(F.col(position).desc()))
    return marked.withColumn("__n", nth).where(F.col("__new") | (F.col("__n") <= again)).drop("__new", "__n")


def probe_scores(answers: DataFrame, key: Cols, text: str, wanted: str, names: DataFrame, name: str, value: str) -> DataFrame:
    """(key, named, hits, precision): the distinct words of an answer that are names, and how many of those stand for what is wanted.

    names(name, value) is a table of any size; words meet it by an equi-join.
    """
    words = answers.select(*key, wanted, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))).alias(name))
    hit = words.join(names.select(name, value), name)
    g = hit.groupBy(*key).agg(F.count("*").alias("named"), F.count_if(F.col(value) == F.col(wanted)).alias("hits"))
    return g.withColumn("precision", F.col("hits") / F.col("named"))


def sole_group(rows: DataFrame, key: Cols, group: str, name: str) -> DataFrame:
    """rows with their group; those without one join the only group of their key, if there is just one."""
    within = Window.partitionBy(*key)
    only = F.when(F.min(group).over(within) == F.max(group).over(within), F.min(group).over(within))
    return rows.withColumn(name, F.coalesce(group, only))


def by_primary(rows: DataFrame, primaries: DataFrame, facts: DataFrame, key: str, primary: str) -> DataFrame:
    """rows with the facts of their primary: key to primary, primary to facts; null where either is unknown."""
    return rows.join(primaries.select(key, primary), key, "left").join(facts, primary, "left").drop(primary)
