"""Outlier thresholds of similarities, per node or over all of them, also where most of a node's similarities are zeros that nobody stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from eventloom.runtime import cut

METHODS = ("zscore", "iqr", "percentile", "mad")
DEFAULTS = {"zscore": 2.0, "iqr": 3.0, "percentile": 95.0, "mad": 3.5}

#: Values of a key up to which one task sorts them; bits that a round of the selection over larger keys settles.
HOT, DIGIT = 200_000, 16


@F.pandas_udf(LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A long for each double, in the same order: a double's bits, those of negative ones turned round; -0.0 counts as 0.0."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


@F.pandas_udf(DoubleType())
def from_ordered_bits(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits).view(np.float64))


def selected(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, rank long) with `found`, the key's rank-th smallest value (from 0); values: key, value double, no nulls; ranks lie within the key's values.

    Histograms over the ordered bits, DIGIT bits a round, from the highest on: each round counts the next digit of the values that still share
    the settled bits of some rank, and settles another digit. Counts are summed before they are shuffled, so the values of a key never meet.
    """
    bits = cut(values.select("key", ordered_bits("value").alias("bits")))
    # The sign bit is turned, so that digits compare as numbers without a sign.
    state = cut(asked.select("key", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("high")))
    flipped = bits.withColumn("bits", F.expr("bits ^ shiftleft(1L, 63)"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        high = F.shiftrightunsigned("bits", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND((1 << DIGIT) - 1)
        live = flipped.select("key", high.alias("high"), digit.alias("digit")).join(F.broadcast(state.select("key", "high").distinct()), ["key", "high"], "left_semi")
        counts = live.groupBy("key", "high", "digit").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("key", "high").orderBy("digit")  # 2 ** DIGIT rows at most
        counts = counts.withColumn("upto", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        met = state.join(counts, ["key", "high"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        state = cut(met.select("key", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), (F.shiftleft("high", DIGIT) + F.col("digit")).alias("high")))
    return state.select("key", "rank", from_ordered_bits(F.expr("high ^ shiftleft(1L, 63)")).alias("found"))


def quantiles(values: DataFrame, shares: list[float], implied: DataFrame | None = None) -> DataFrame:
    """(key, q array<double>): exact quantiles, interpolated between neighbours, of each key's values (key, value) and of the implied ones.

    implied: (key, c double, z long), z more values c of a key, which are never written out: ranks beyond those values below c shift by z. Keys of up to HOT values are
    sorted by a task each, those of larger ones selected by histograms (`selected`). Null values are left out.
    """
    values = values.where("value is not null")
    if implied is None:
        sizes = values.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(sizes.where(F.col("n") > HOT))
        if hot.isEmpty():
            return values.groupBy("key").agg(F.percentile("value", F.array(*[F.lit(s) for s in shares])).alias("q"))
        implied = hot.limit(0).select("key", F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("z"))
    seen = values.join(implied, "key", "left").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") < F.col("c"), 1)).alias("below"))
    sizes = implied.join(seen, "key", "full").select("key", F.coalesce("c", F.lit(0.0)).alias("c"), *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("z", "n", "below")]).where("n + z > 0")
    # A quantile lies between two ranks of all values; a rank is one of the stored values, or the implied one (-1).
    place = lambda s: F.lit(float(s)) * (F.col("n") + F.col("z") - 1)
    stored = lambda r: F.when(r < F.col("below"), r).when(r < F.col("below") + F.col("z"), F.lit(-1).cast("long")).otherwise(r - F.col("z"))
    ends = [(end(place(s)).cast("long"), place(s)) for s in shares for end in (F.floor, F.ceil)]
    sizes = cut(sizes.select("key", "c", "n", F.array(*[stored(r) for r, _ in ends]).alias("ranks"), F.array(*[p - F.floor(p) for _, p in ends[::2]]).alias("parts")))
    small = values.join(sizes.where(F.col("n") <= HOT).select("key"), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    found = sizes.where(F.col("n") <= HOT).join(small, "key", "left").select("key", "parts", F.transform("ranks", lambda r: F.when(r < 0, F.col("c")).otherwise(F.get("sorted", r))).alias("x"))
    large = sizes.where(F.col("n") > HOT)
    if not large.isEmpty():
        asked = large.select("key", "c", "parts", F.posexplode("ranks").alias("i", "rank"))
        got = selected(values.join(F.broadcast(large.select("key")), "key", "left_semi"), asked.where("rank >= 0").select("key", "rank").distinct())
        each = asked.join(got, ["key", "rank"], "left").withColumn("found", F.coalesce("found", "c"))
        each = each.groupBy("key").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("i", "found"))).alias("x"))
        found = found.union(each.select("key", "parts", F.col("x.found")))
    mixed = [(F.lit(1.0) - F.col("parts")[i]) * F.col("x")[2 * i] + F.col("parts")[i] * F.col("x")[2 * i + 1] for i in range(len(shares))]
    return found.select("key", F.array(*[F.when(F.col("x")[2 * i] == F.col("x")[2 * i + 1], F.col("x")[2 * i]).otherwise(m) for i, m in enumerate(mixed)]).alias("q"))


def thresholds(values: DataFrame, method: str, n: float | None = None, key: str | None = "u", value: str = "weight", zeros: DataFrame | None = None) -> DataFrame:
    """(key, threshold): mean + n deviations, upper quartile + n quartile ranges, a percentile, or median + n scaled median deviations; key None: one row over all values.

    zeros: (key, z), how many similarities of 0 each key has that `values` does not hold; they count as if they were there. Keys of any size are
    spread over tasks.
    """
    if method not in METHODS:
        raise ValueError(f"unknown threshold {method!r}: use one of {METHODS}")
    n = float(DEFAULTS[method] if n is None else n)
    named: Column = F.col(key) if key else F.lit(0)
    plain = values.select(named.alias("key"), F.col(value).cast("double").alias("value"))
    implied = None if zeros is None else zeros.select(F.col(key).alias("key") if key else F.lit(0).alias("key"), F.lit(0.0).alias("c"), F.col("z").cast("long").alias("z"))
    if method == "zscore":
        own = plain.groupBy("key").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
        z = F.lit(0).cast("long")
        if implied is not None:
            own, z = own.join(implied, "key", "full").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m", "v", "z")]), F.col("z")
        mean = F.col("n") * F.col("m") / (F.col("n") + z)
        spread = (F.col("n") * (F.col("v") + F.pow(F.col("m") - mean, 2)) + z * mean * mean) / (F.col("n") + z)
        out = own.where(F.col("n") + z > 0).select("key", (mean + F.lit(n) * F.sqrt(spread)).alias("threshold"))
    elif method == "mad":
        # The exact median of the deviations takes a second pass over the values; implied zeros are as far off as the median.
        middle = quantiles(plain, [0.5], implied).select("key", F.col("q")[0].alias("middle"))
        middle = cut(middle) if implied is not None else middle
        off = plain.join(F.broadcast(middle) if key is None else middle, "key").select("key", F.abs(F.col("value") - F.col("middle")).alias("value"), "middle")
        far = None if implied is None else implied.join(middle, "key").select("key", F.abs("middle").alias("c"), "z")
        if far is None and key is not None:
            off = cut(off)
        middles = off.groupBy("key").agg(F.first("middle").alias("middle")) if far is None else middle
        out = quantiles(off.select("key", "value"), [0.5], far).join(middles, "key").select("key", (F.col("middle") + F.lit(n) * F.col("q")[0] / F.lit(0.6745)).alias("threshold"))
    else:
        q = quantiles(plain, [0.25, 0.75] if method == "iqr" else [n / 100.0], implied)
        out = q.select("key", (F.col("q")[1] + F.lit(n) * (F.col("q")[1] - F.col("q")[0]) if method == "iqr" else F.col("q")[0]).alias("threshold"))
    return out.select(F.col("key").alias(key), "threshold") if key else out.select("threshold")
