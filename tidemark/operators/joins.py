"""Joins beyond equality: as-of, unique, one-to-one, positional, interval and ordered matches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Cols = Sequence[str]
BROADCAST_ROWS = 400_000  # of a few columns
DEALT = 64  # parts of the rows that are met with others
LEFT_BLOCK, RIGHT_BLOCK = 65_536, 1024  # about so many rows of a key are met at once


def asof_backward(left: DataFrame, right: DataFrame, key: Cols, at: str, values: Cols, tie: Cols, strict: bool = False) -> DataFrame:
    """left with the values of the latest right row of its key at or before (strict: before) ``at``.

    Both sides are one stream sorted by time; the last right row is carried forward, so each key is read
    once and no pairs are made. tie: columns of right that order equal times (the last wins).
    """
    held = F.struct(*[F.col(v).alias(v) for v in values])
    a = left.select(*key, F.col(at).alias("__t"), F.lit(1 if strict is False else 0).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__held"), F.lit(None).cast(right.select(F.struct(*tie).alias("h")).schema["h"].dataType).alias("__tie"))
    b = right.select(*key, F.col(at).alias("__t"), F.lit(0 if strict is False else 1).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), held.alias("__held"), F.struct(*tie).alias("__tie"))
    order = Window.partitionBy(*key).orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("__found", F.last("__held", ignorenulls=True).over(order)).where("__row is not null")
    return both.select("__row.*", *[F.col("__found")[v].alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, key: Cols, at: str, values: Cols, tie: Cols) -> DataFrame:
    """left with the values of the first right row of its key at or after ``at``."""
    held = F.struct(*[F.col(v).alias(v) for v in values])
    a = left.select(*key, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__held"), F.lit(None).cast(right.select(F.struct(*tie).alias("h")).schema["h"].dataType).alias("__tie"))
    b = right.select(*key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), held.alias("__held"), F.struct(*tie).alias("__tie"))
    order = Window.partitionBy(*key).orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = a.unionByName(b).withColumn("__found", F.first("__held", ignorenulls=True).over(order)).where("__row is not null")
    return both.select("__row.*", *[F.col("__found")[v].alias(v) for v in values])


def unique_match(left: DataFrame, right: DataFrame, on: Cols, how: str = "left") -> DataFrame:
    """left joined to right rows whose key occurs exactly once there: two candidates are none."""
    others = [c for c in right.columns if c not in on]
    single = right.groupBy(*on).agg(F.count("*").alias("__n"), *[F.min(F.struct(F.col(c).alias("v"))).alias(c) for c in others]).where("__n = 1")
    return left.join(single.select(*on, *[F.col(c)["v"].alias(c) for c in others]), list(on), how)


def one_to_one(left: DataFrame, right: DataFrame, on: Cols, left_order: Cols, right_order: Cols) -> DataFrame:
    """The n-th left row of a key with the n-th right row, nulls of the key being equal; leftovers of both sides stay."""
    a = left.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(*left_order)))
    b = right.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(*right_order)))
    b = b.select(*[F.col(c).alias(f"__r_{c}") for c in on], F.col("__n").alias("__m"), *[c for c in right.columns if c not in on])
    same = F.col("__n") == F.col("__m")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    joined = a.join(b, same, "full")
    keys = [F.when(F.col("__n").isNotNull(), F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c) for c in on]
    return joined.select(*keys, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])


def zip_join(left: DataFrame, right: DataFrame, key: Cols, left_order: Cols, right_order: Cols) -> DataFrame:
    """The n-th rows of both sides of each key whose sides have equally many rows; other keys give none."""
    a = left.withColumns({"__n": F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)), "__all": F.count("*").over(Window.partitionBy(*key))})
    b = right.withColumns({"__n": F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)), "__all": F.count("*").over(Window.partitionBy(*key))})
    return a.join(b, [*key, "__n", "__all"]).drop("__all").withColumnRenamed("__n", "position")


def any_key_match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], left_id: Cols, right_id: Cols) -> DataFrame:
    """Pairs of ids that agree on any of the column pairs, each once: a union of equi-joins instead of an OR.

    A pair of ids that have one row each is told by the first column pair that it agrees on, so these need no shuffle to be
    distinct, however many there are; only pairs of an id of several rows do. Rows of a key are dealt to blocks, and each row to all blocks of
    the other side: a key that very many rows have is many parts, of which none holds more than a right block, and a written part
    repeats the same few ids, which columns of a file are small for. Nothing that grows with a side is broadcast.
    """

    def side(rows: DataFrame, ident: Cols, columns: Cols) -> DataFrame:
        rows = rows.select(F.struct(*ident).alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)])
        # rows of an id lie together once dealt, so that neither equal ones nor their number need another shuffle
        return rows.repartition("__id").distinct().withColumn("__several", F.count("*").over(Window.partitionBy("__id")) > 1)

    def with_blocks(rows: DataFrame, key: Column, most: int, name: str):
        """What adds to rows of __key how many blocks of ``most`` it has on this side; most keys have one."""
        large = rows.groupBy(key.alias("__key")).agg(F.ceil(F.count("*") / most).alias(name)).where(f"__key is not null and {name} > 1")
        n = large.count()
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        return lambda side: side.join(large, "__key", "left").fillna(1, [name]) if n else side.withColumn(name, F.lit(1).cast("long"))

    a, b = side(left, left_id, [x for x, _ in pairs]), side(right, right_id, [y for _, y in pairs])
    counts = [(with_blocks(left, F.col(x), LEFT_BLOCK, "__of_left"), with_blocks(right, F.col(y), RIGHT_BLOCK, "__of_right")) for x, y in pairs]

    def dealt(rows: DataFrame, i: int, own: str, other: str, row: str) -> DataFrame:
        rows = rows.where(f"__k{i} is not null").select(F.col(f"__k{i}").alias("__key"), F.struct("__id", *[f"__k{k}" for k in range(i)]).alias(row))
        for add in counts[i]:
            rows = add(rows)
        block = {f"__of_{own}": F.pmod(F.xxhash64(f"{row}.__id"), F.col(f"__of_{own}")), f"__of_{other}": F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__of_{other}") - 1))}
        at = [F.col("__key"), *[block[k].alias(k[5:]) for k in ("__of_left", "__of_right")]]
        # a given number of parts, as few bytes may meet very many rows
        return rows.select(row, *at).repartition(DEALT, "__key", "left", "right")

    def met(a: DataFrame, b: DataFrame, once: bool) -> DataFrame:
        found = None
        for i in range(len(pairs)):
            one = dealt(a, i, "left", "right", "__l").join(dealt(b, i, "right", "left", "__r").hint("merge"), ["__key", "left", "right"])
            for k in range(i if once else 0):
                one = one.where(~F.coalesce(F.col(f"__l.__k{k}") == F.col(f"__r.__k{k}"), F.lit(False)))
            one = one.select("__l.__id.*", "__r.__id.*")
            found = one if found is None else found.unionByName(one)
        return found

    single, several = met(a.where("not __several"), b.where("not __several"), True), met(a.where("__several"), b, False).unionByName(met(a.where("not __several"), b.where("__several"), False))
    return single.unionByName(several.distinct())


def once_each(rows: DataFrame, column: str, made: dict[str, Column]) -> DataFrame:
    """rows with columns that follow from one column alone, worked out once for each of its values, null among them."""
    values = rows.select(F.col(column).alias("__of")).distinct()
    told = values.select("__of", *[c.alias(name) for name, c in made.items()])
    return rows.join(F.broadcast(told) if values.count() <= BROADCAST_ROWS else told, F.col(column).eqNullSafe(F.col("__of")), "left").drop("__of")


def interval_overlaps(df: DataFrame, place: Cols, ident: str, start: str, end: str, width: int) -> DataFrame:
    """Unordered pairs of ids at one place whose intervals overlap; null ends are open, touching ends don't overlap.

    Intervals are dealt to time buckets of ``width`` seconds, so a place with many intervals is not
    compared with itself whole. A pair is told in the bucket where the later one starts, so none is
    told twice. Open intervals reach to the place's last start.
    """
    number = lambda c: F.floor(F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))") / width)
    rows = df.where(F.col(start).isNotNull()).withColumn("__last", F.max(start).over(Window.partitionBy(*place)))
    rows = rows.withColumn("__reach", F.greatest(F.least(F.coalesce(end, "__last"), F.col("__last")), F.col(start)))
    spread = rows.withColumn("__b", F.explode(F.sequence(number(start), number("__reach"))))
    a = spread.select(*place, "__b", F.col(ident).alias("a_id"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = spread.where(F.col("__b") == number(start)).select(*place, "__b", F.col(ident).alias("b_id"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    first = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_id") < F.col("b_id")))
    hit = F.coalesce(F.col("b_start") < F.col("a_end"), F.lit(True)) & F.coalesce(F.col("a_start") < F.col("b_end"), F.lit(True))
    pairs = a.join(b, [*place, "__b"]).where(first & hit)
    return pairs.select(*place, F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"))


def band_join(left: DataFrame, right: DataFrame, on: Cols, left_at: str, right_at: str, low: int, high: int) -> DataFrame:
    """Equi-join with right_at between left_at+low and left_at+high (integer positions).

    Each left row is told once for each of the few positions, so that a key with very many rows doesn't meet itself whole.
    """
    kind = dict(right.dtypes)[right_at]
    near = left.withColumn("__near", F.explode(F.sequence((F.col(left_at) + low).cast(kind), (F.col(left_at) + high).cast(kind))))
    there = right.withColumn("__near", F.col(right_at))
    return near.join(there, [*on, "__near"]).drop("__near")


def ordered_match(left: DataFrame, right: DataFrame, key: Cols, on: Cols, left_order: str, right_order: str, left_id: str, right_id: str) -> DataFrame:
    """Two sequences of a key paired in order by equality on ``on``; the cursor never goes back.

    Each left row takes the first right row behind the last one taken that equals it. The choice depends
    on all earlier ones, so a key's two sequences are walked together; a key is one session.
    """
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def walk(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in [*key, left_id, right_id]})
        a, b = a.sort_values([left_order, left_id]), b.sort_values([right_order, right_id])
        places: dict = {}
        for i, row in enumerate(b[list(on)].itertuples(index=False, name=None)):
            places.setdefault(row, []).append(i)
        cursor, out, seen = 0, [], dict.fromkeys(places, 0)
        for row, ident in zip(a[list(on)].itertuples(index=False, name=None), a[left_id], strict=True):
            spots = places.get(row, ())
            at = seen.get(row, 0)
            while at < len(spots) and spots[at] < cursor:
                at += 1
            if row in seen:
                seen[row] = at
            if at < len(spots):
                cursor = spots[at] + 1
                out.append((*[a[k].iloc[0] for k in key], ident, b[right_id].iloc[spots[at]]))
        return pd.DataFrame(out, columns=[*key, left_id, right_id])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, left_id, right_id])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(walk, schema)


def ranked_pick(rank: Column, order: str, present: Column, value: Column) -> Column:
    """The value of the best-ranked row that has the field, though it be null there."""
    return F.min_by(F.struct(value.alias("v")), F.when(present, F.struct(rank.alias("r"), F.col(order).alias("o"))))["v"]
