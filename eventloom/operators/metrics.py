"""Classification reports, agreement, novelty, perplexity and rank tests as aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.pairs import block


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_counts(rows: DataFrame, keys: list[str], label: str = "label", pred: str = "pred", sets: list[list[str]] | None = None) -> DataFrame:
    """keys + (class, tp, fp, fn): for each boolean class that occurs among labels or predictions. sets: groupings of keys, as grouping sets."""
    ends = rows.select(*keys, F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(True).alias("true_side")), F.struct(F.col(pred).alias("class"), F.lit(False).alias("true_side")))).alias("e"), F.col(label).alias("_l"), F.col(pred).alias("_p"))
    ends = ends.select(*keys, "e.class", ((F.col("_l") == F.col("_p")) & F.col("e.true_side")).cast("long").alias("tp"), ((F.col("_l") != F.col("_p")) & F.col("e.true_side")).cast("long").alias("fn"), ((F.col("_l") != F.col("_p")) & ~F.col("e.true_side")).cast("long").alias("fp"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    if sets is None:
        return ends.groupBy(*keys, "class").agg(*sums)
    return ends.groupingSets([[F.col(c) for c in [*s, "class"]] for s in sets], *[F.col(c) for c in [*keys, "class"]]).agg(*sums)


def report(rows: DataFrame, keys: list[str], label: str = "label", pred: str = "pred", sets: list[list[str]] | None = None) -> DataFrame:
    """keys + accuracy, macro and weighted precision, recall and F1, support: over the union of the classes that occur; a ratio without denominator is 0."""
    per = class_counts(rows, keys, label, pred, sets)
    per = per.withColumn("p", _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("r", _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))).withColumn("f", _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("s", F.col("tp") + F.col("fn"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("s")) / F.sum("s"))
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("s")).alias("accuracy"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"),
        weighted("p").alias("weighted_precision"), weighted("r").alias("weighted_recall"), weighted("f").alias("weighted_f1"), F.sum("s").alias("support"),
    )


def confusion(rows: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """keys + (label, pred, n, share): counts of a confusion matrix and their share of the label's row."""
    n = rows.groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "label")))


def with_dummies(groups: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """The reports of all groups; one without any valid answer gets accuracy, precision, recall and F1 of 0 and a support of 2."""
    out = groups.join(reports, keys, "left")
    return out.fillna(0.0, [c for c in reports.columns if c not in (*keys, "support")]).fillna(2, ["support"])


def perplexity(losses: DataFrame, key: str, loss: str = "loss", mask: str = "mask") -> DataFrame:
    """(key, perplexity): exp of the mean loss of the positions that the mask keeps; null without any."""
    kept = F.col(mask).cast("double")
    return losses.groupBy(key).agg((F.exp(F.try_divide(F.sum(F.col(loss) * kept), F.sum(kept)))).alias("perplexity"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys + count, mean, sample deviation, minimum, quartiles and maximum of value."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = rows.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return stats.select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def novelty(generated: DataFrame, train: DataFrame, tile: int = 2048) -> DataFrame:
    """(id, novelty): 1 minus the highest inner product of each generated vector (id, vec) with any train vector.

    Both sides are dealt over tiles of about `tile` rows, as many as they need; every two of them meet in one matrix product, whose maxima are combined.
    """
    many = [max(1, -(-frame.count() // tile)) for frame in (generated, train)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    g = generated.select("id", "vec", own(many[0]).alias("a"), every(many[1]).alias("b"))
    t = train.select(F.col("id").alias("id"), F.col("vec").alias("vec"), every(many[0]).alias("a"), own(many[1]).alias("b"))

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        most = (block(x["vec"]) @ block(y["vec"]).T).max(axis=1) if len(x) and len(y) else np.zeros(0)
        return pa.table([x["id"] if len(most) else x["id"].slice(0, 0), pa.array(most)], names=["id", "most"])

    found = g.groupBy("a", "b").cogroup(t.groupBy("a", "b")).applyInArrow(nearest, f"id {generated.schema['id'].dataType.simpleString()}, most double")
    return found.groupBy("id").agg((1 - F.max("most")).alias("novelty"))


def early_stopping(log: DataFrame, order: str, value: str, patience: int) -> DataFrame:
    """log + best (so far, before the row), improved, stale (evaluations since the last improvement), stop (stale reached patience). One training run's log is short: it is one window."""
    run = Window.orderBy(order)
    best = F.max(value).over(run.rowsBetween(Window.unboundedPreceding, -1))
    out = log.withColumn("best", best).withColumn("improved", F.col("best").isNull() | (F.col(value) > F.col("best")))
    last = F.sum(F.col("improved").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_g", last)
    stale = F.row_number().over(Window.partitionBy("_g").orderBy(order)) - 1
    return out.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).drop("_g")


def friedman(scores: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """One row: the Friedman statistic with tie correction, over blocks that hold every group; null for a single group, or if all are tied."""
    ranked = scores.withColumn("_min", F.rank().over(Window.partitionBy(block).orderBy(value))).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(block, value)))
    ranked = ranked.withColumn("r", F.col("_min") + (F.col("_same") - 1) / 2.0)
    sums = ranked.groupBy(group).agg(F.sum("r").alias("R")).agg(F.sum(F.col("R") * F.col("R")).alias("ss"), F.count(F.lit(1)).alias("k"))
    ties = ranked.agg(F.sum(F.col("_same") * F.col("_same") - 1).alias("ties"), F.countDistinct(block).alias("n"))
    one = sums.crossJoin(ties)  # single rows
    k, n = F.col("k"), F.col("n")
    even = 1 - F.try_divide(F.col("ties").cast("double"), n * k * (k * k - 1.0))
    return one.select(k, n, F.try_divide(F.try_divide(F.lit(12.0), n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1), even).alias("statistic"))


def wilcoxon(scores: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """(a, b, n, w): signed-rank statistics of every two groups over the blocks they share; zero differences are left out."""
    left, right = (scores.select(block, F.col(group).alias(x), F.col(value).alias(f"v{x}")) for x in ("a", "b"))
    diff = left.join(right, block).where("a < b").withColumn("d", F.round(F.col("va") - F.col("vb"), 12)).where("d <> 0")
    low = F.rank().over(Window.partitionBy("a", "b").orderBy(F.abs("d")))
    same = F.count(F.lit(1)).over(Window.partitionBy("a", "b", F.abs("d")))
    diff = diff.withColumn("low", low).withColumn("same", same).withColumn("r", F.col("low") + (F.col("same") - 1) / 2.0)
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    return diff.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.least(plus, minus).alias("w"))


def holm(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """tests + rejected: Holm's step-down; the tests of one comparison are few and form one window."""
    order = Window.orderBy(p)
    count = F.count(F.lit(1)).over(Window.partitionBy())
    step = tests.withColumn("_ok", (F.col(p) <= F.lit(alpha) / (count - F.row_number().over(order) + 1)).cast("int"))
    return step.withColumn("rejected", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
