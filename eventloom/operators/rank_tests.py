"""p-values of rank tests: Friedman's from the chi-square tail, Wilcoxon's from the exact distribution of signed ranks, and the leaderboard that follows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from eventloom.operators.metrics import friedman, holm, wilcoxon

#: Blocks up to which signed ranks are counted out; beyond, their sum is close to normal.
EXACT = 200


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom >= x), by the closed sum for half-integer and integer shapes."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term, total = math.exp(-h), math.exp(-h)
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def signed_rank_p(twice: list[int], w: float) -> float:
    """Two-sided p-value of a signed-rank statistic (the smaller sum) for ranks given as twice their values, which are whole also where ranks are shared.

    Each rank counts to either side with the same chance: the number of ways to every sum grows rank by rank. More than EXACT ranks: the normal law of the same
    mean and variance, with a correction for continuity.
    """
    n, whole = len(twice), sum(twice)
    if not n:
        return 1.0
    if n > EXACT:
        spread = math.sqrt(sum(r * r for r in twice)) / 4
        return min(1.0, math.erfc(max(0.0, whole / 4 - w - 0.5) / spread / math.sqrt(2)))
    share = np.zeros(whole + 1)
    share[0] = 1.0
    for r in twice:
        moved = np.zeros_like(share)
        moved[r:] = share[: whole + 1 - r]
        share = (share + moved) / 2
    return min(1.0, 2 * float(share[: int(round(2 * w)) + 1].sum()))


def friedman_test(scores: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """friedman() with p_value: the chi-square tail of k - 1 degrees of freedom; null where there is no statistic."""

    @F.pandas_udf(DoubleType())
    def tail(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, k in parts:
            yield pd.Series([None if pd.isna(a) else chi_square_tail(float(a), int(b) - 1) for a, b in zip(x, k, strict=True)], dtype="float64")

    return friedman(scores, block, group, value).withColumn("p_value", tail("statistic", "k"))


def wilcoxon_test(scores: DataFrame, block: str, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(a, b, n, w, p_value, rejected): wilcoxon() with two-sided p-values, 1 for two groups that differ nowhere, and whether Holm's step-down at alpha rejects that they are alike."""
    left, right = (scores.select(block, F.col(group).alias(x), F.col(value).alias(f"v{x}")) for x in ("a", "b"))
    met = left.join(right, block).where("a < b").withColumn("d", F.round(F.col("va") - F.col("vb"), 12))
    low = F.rank().over(Window.partitionBy("a", "b").orderBy(F.abs("d")))
    same = F.count(F.lit(1)).over(Window.partitionBy("a", "b", F.abs("d")))
    ranks = met.where("d <> 0").withColumn("twice", 2 * low + same - 1).groupBy("a", "b").agg(F.collect_list("twice").alias("twice"))

    @F.pandas_udf(DoubleType())
    def p(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for twice, w in parts:
            yield pd.Series([1.0 if t is None else signed_rank_p([int(x) for x in t], float(s)) for t, s in zip(twice, w, strict=True)])

    pairs = met.select("a", "b").distinct().join(wilcoxon(scores, block, group, value), ["a", "b"], "left").join(ranks, ["a", "b"], "left")
    tested = pairs.select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), p("twice", "w").alias("p_value"))
    return holm(tested, "p_value", alpha)


def leaderboard(scores: DataFrame, block: str, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(group, mean_rank, wins, losses): mean ranks over blocks, the largest value being first and equal ones sharing, and against how many others a group is better or worse after Holm."""
    low = F.rank().over(Window.partitionBy(block).orderBy(F.desc(value)))
    shared = F.count(F.lit(1)).over(Window.partitionBy(block, value))
    means = scores.withColumn("r", low + (shared - 1) / 2.0).groupBy(group).agg(F.avg("r").alias("mean_rank"))
    tests = wilcoxon_test(scores, block, group, value, alpha).where("rejected").select("a", "b")
    both = tests.union(tests.select("b", "a")).join(means.select(F.col(group).alias("a"), F.col("mean_rank").alias("mine")), "a").join(means.select(F.col(group).alias("b"), F.col("mean_rank").alias("theirs")), "b")
    won = both.groupBy(F.col("a").alias(group)).agg(F.count_if(F.col("mine") < F.col("theirs")).alias("wins"), F.count_if(F.col("mine") > F.col("theirs")).alias("losses"))
    zero = F.lit(0).cast("long")
    return means.join(won, group, "left").select(group, "mean_rank", F.coalesce("wins", zero).alias("wins"), F.coalesce("losses", zero).alias("losses"))
