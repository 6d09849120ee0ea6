"""Joins whose keys may hold a large share of all rows, and column names that clash with none of a user's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Rows of a key that one task takes; keys that are split at most.
HOT, MOST_HOT = 200_000, 10_000


def fresh(taken: Iterable[str], stem: str) -> str:
    """stem, or stem with as many underscores as make it differ from all taken names, whatever their case."""
    known = {c.lower() for c in taken}
    while stem.lower() in known:
        stem += "_"
    return stem


def join_salted(big: DataFrame, small: DataFrame, key: str, rows: str, by: str, how: str = "inner") -> DataFrame:
    """big joined with small on key; small has each key once, and in `rows` how many rows of big hold it (left out of the result).

    A key of more than HOT rows (more, if those keys would be over MOST_HOT) is split by a hash of `by`, its row of small going to every part.
    The split keys are broadcast: MOST_HOT rows at most, whatever the size of big. how: inner, left or left_semi; null keys meet nothing.
    """
    sizes = small.agg(F.max(rows).alias("most"), F.sum(rows).alias("all")).first()
    if (sizes["most"] or 0) <= HOT:
        return big.join(small.drop(rows), key, how)
    each = max(HOT, -(-sizes["all"] // MOST_HOT))
    parts, salt = fresh([*big.columns, *small.columns], "parts"), fresh([*big.columns, *small.columns], "salt")
    hot = small.where(F.col(rows) > each).select(key, F.ceil(F.col(rows) / each).alias(parts))
    left = big.join(F.broadcast(hot), key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)), F.lit(0))).drop(parts)
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(rows) > each, F.ceil(F.col(rows) / each)).otherwise(1) - 1))).drop(rows)
    return left.join(right, [key, salt], how).drop(salt)


def number_within(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `number`, from 0 among those of equal keys (nulls equal nulls) in the order of `order`; rows may hold no columns k, part, first, n0.

    Range partitions number their own rows, so that keys of any size are spread over tasks; a group that goes on in the next partition adds what it had
    before, one row a partition at most, which is broadcast.
    """
    dealt = cut(rows.orderBy(*keys, *order).withColumn("k", F.monotonically_increasing_id()).withColumn("part", F.shiftright("k", 33)))
    pieces = dealt.groupBy(*keys, "part").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    late = pieces.select("first", F.sum("n").over(before).alias("n0")).where("n0 is not null")
    here = Window.partitionBy(*keys, "part").orderBy("k")
    local = dealt.withColumn("first", F.min("k").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("number", F.row_number().over(here) - 1)
    return local.join(F.broadcast(late), "first", "left").withColumn("number", F.col("number") + F.coalesce("n0", F.lit(0).cast("long"))).drop("k", "part", "first", "n0")
