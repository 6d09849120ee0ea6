"""Evaluation splits, negatives and weighted samples; every draw is ordered by a hash of a seed and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.rand import race, u01
from eventloom.operators.negatives import drawn_pairs, free_pairs, hard_pairs, with_similarity
from eventloom.operators.thresholds import quantiles
from eventloom.runtime import cut

# Label files carry these strings.
LABELS = (
    "easy true edge (above 75th percentile similarity)",
    "medium true edge (between 50th and 75th percentile similarity)",
    "medium true edge (between 25th and 50th percentile similarity)",
    "hard true edge (below 25th percentile similarity)",
    "hard semantic negative",
    "temporal plausible negative",
    "random negative",
)


def quota(n: int, share: float | int) -> int:
    """A share in (0, 1] of n, or an absolute number."""
    if isinstance(share, float) and 0 < share <= 1:
        return int(n * share)
    if isinstance(share, int) and share >= 1:
        return min(n, share)
    raise ValueError("a share is a float in (0, 1] or a whole number from 1")


def test_nodes(nodes: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """(seq_id): the latest nodes without an outgoing edge, int(n * share) at most."""
    sinks = nodes.join(edges.select(F.col("u").alias("seq_id")).distinct(), "seq_id", "left_anti")
    return sinks.orderBy(F.desc("when"), "seq_id").limit(int(nodes.count() * share)).select("seq_id")


def true_edges(edges: DataFrame, test: DataFrame, share: float | int, seed: int) -> DataFrame:
    """A sample of the edges into test nodes, bridges left out."""
    found = cut(edges.where("edge_type <> 'component_bridge'").join(test.select(F.col("seq_id").alias("v")), "v", "left_semi").select("u", "v", "what_sim"))
    return found.orderBy(u01(seed, "u", "v"), "u", "v").limit(quota(found.count(), share))


def difficulty(true: DataFrame) -> DataFrame:
    """True edges with the label of their quartile of similarity."""
    q = quantiles(true.select(F.lit(0).alias("key"), F.col("what_sim").alias("value")), [0.25, 0.5, 0.75]).select("q")
    s = F.col("what_sim")
    name = F.when(s >= F.col("q")[2], LABELS[0]).when(s >= F.col("q")[1], LABELS[1]).when(s >= F.col("q")[0], LABELS[2]).otherwise(LABELS[3])
    return true.crossJoin(F.broadcast(q)).select("u", "v", F.lit(True).alias("label"), name.alias("label_description"), "what_sim")


def labelled_split(nodes: DataFrame, edges: DataFrame, test_share: float = 0.1, edge_share: float | int = 1.0, hard: float = 0.4, temporal: float = 0.3, window: int = 31, seed: int = 2026) -> DataFrame:
    """(u, v, label, label_description, what_sim): true test edges by difficulty, and as many negatives in three kinds, none twice (fewer, if fewer pairs are free).

    Negatives lead from train nodes to test nodes: the most alike, then draws among those where v follows u within `window` days, then draws among all that are left.
    """
    edges = cut(edges)
    test = cut(test_nodes(nodes, edges, test_share))
    true = cut(true_edges(edges, test, edge_share, seed))
    n = true.count()
    barred = edges.select("u", "v")
    most_alike = cut(hard_pairs(nodes, test, barred, int(n * hard)))
    barred = cut(barred.union(most_alike.select("u", "v")))
    plausible = cut(with_similarity(drawn_pairs(free_pairs(nodes, test, barred, window), int(n * temporal), seed), nodes))
    barred = cut(barred.union(plausible.select("u", "v")))
    other = with_similarity(drawn_pairs(free_pairs(nodes, test, barred), n - int(n * hard) - int(n * temporal), seed), nodes)
    out = difficulty(true)
    for frame, name in ((most_alike, LABELS[4]), (plausible, LABELS[5]), (other, LABELS[6])):
        out = out.union(frame.select("u", "v", F.lit(False), F.lit(name), "what_sim"))
    return out


def weighted_edges(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """k edges without replacement, with chances in proportion to their weights."""
    return edges.withColumn("key", race(u01(seed, "u", "v"), F.col("weight"))).orderBy("key", "u", "v").limit(k).drop("key")


def weight_bucket(weight: Column, low: Column, high: Column) -> Column:
    """low <= weight < high."""
    return (weight >= low) & (weight < high)


def non_edges(nodes: DataFrame, edges: DataFrame, wanted: int, seed: int) -> DataFrame:
    """(u, v): `wanted` different pairs without an edge in either direction, or all if there are fewer: the first of uniform draws of two nodes (numbered from 0).

    Twice as many are drawn again, until there are enough.
    """
    n = nodes.count()
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    wanted, draws = min(wanted, n * (n - 1) - both.count()), 2 * max(1, wanted)
    while True:
        drawn = nodes.sparkSession.range(draws).select("id", F.floor(u01(seed, "id", F.lit("u")) * n).cast("long").alias("u"), F.floor(u01(seed, "id", F.lit("v")) * n).cast("long").alias("v"))
        found = cut(drawn.where("u <> v").groupBy("u", "v").agg(F.min("id").alias("id")).join(both, ["u", "v"], "left_anti").orderBy("id").limit(wanted))
        if found.count() >= wanted:
            return found.select("u", "v")
        draws *= 2


#: Hashed draws of a node before the nodes that are left to draw from are counted.
DRAWS = 16


def non_neighbours(prompts: DataFrame, keys: list[str], edges: DataFrame, n: int, draw: Callable[[Column], Column]) -> DataFrame:
    """keys + rejected: for each prompt a uniform draw among the n nodes (numbered from 0) that are neither its `node` nor after an edge from there; a prompt without such a node is left out.

    prompts: keys + node; draw(k): the k-th number in [0, 1) of a prompt. The first of DRAWS draws that hits counts. For those that all miss, which
    is likely only where most nodes are neighbours, draw DRAWS picks a place among the nodes that are left: the r-th of them is r plus the neighbours before it.
    """
    taken = edges.select(F.col("u").alias("node"), F.col("v").alias("w")).distinct()
    drawn = prompts.select(*keys, "node", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("k"))
    drawn = drawn.withColumn("w", F.floor(draw(F.col("k")) * n).cast("long")).where("w <> node")
    hit = cut(drawn.join(taken, ["node", "w"], "left_anti").groupBy(*keys).agg(F.min_by("w", "k").alias("rejected")))
    left = cut(prompts.join(hit, keys, "left_anti"))
    if left.isEmpty():
        return hit
    barred = left.select("node").distinct().withColumn("w", F.col("node")).union(taken.join(left.select("node"), "node", "left_semi")).where(F.col("w").between(0, n - 1)).distinct()
    barred = cut(barred.withColumn("free", F.col("w") - F.row_number().over(Window.partitionBy("node").orderBy("w")) + 1))  # free nodes before it
    counts = barred.groupBy("node").agg((n - F.count(F.lit(1))).alias("left")).where("left > 0")
    placed = left.join(counts, "node").withColumn("r", F.floor(draw(F.lit(DRAWS)) * F.col("left")).cast("long"))
    before = placed.join(barred, "node").groupBy(*keys, "r").agg(F.count(F.when(F.col("free") <= F.col("r"), 1)).alias("before"))
    return hit.unionByName(before.select(*keys, (F.col("r") + F.col("before")).alias("rejected")))


def weight_summary(edges: DataFrame) -> DataFrame:
    """One row (n, mean, median, std, min, max, q1, q3, p90) of the weights of edges, which no task holds together."""
    one = edges.agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.min("weight").alias("min"), F.max("weight").alias("max"))
    q = quantiles(edges.select(F.lit(0).alias("key"), F.col("weight").alias("value")), [0.5, 0.25, 0.75, 0.9]).select("q")
    return one.join(F.broadcast(q), how="left").select("n", "mean", F.col("q")[0].alias("median"), "std", "min", "max", *[F.col("q")[k].alias(c) for k, c in enumerate(("q1", "q3", "p90"), 1)])


def training_edges(edges: DataFrame, share: float | int, seed: int) -> DataFrame:
    """A sample of similarity edges for training, bridges left out: a share in (0, 1] of them, or a number, in proportion to nothing but a hash."""
    found = cut(edges.where("edge_type <> 'component_bridge'"))
    return found.orderBy(u01(seed, F.lit("train"), "u", "v"), "u", "v").limit(quota(found.count(), share))


def labelled_training(nodes: DataFrame, edges: DataFrame, share: float | int, seed: int, negatives: bool = True) -> DataFrame:
    """(u, v, label): sampled similarity edges, and as many pairs without an edge."""
    true = cut(training_edges(edges, share, seed).select("u", "v", F.lit(True).alias("label")))
    return true.union(non_edges(nodes, edges, true.count(), seed).select("u", "v", F.lit(False))) if negatives else true


def bucket_samples(edges: DataFrame, buckets: dict[str, tuple[float, float]], each: int, seed: int) -> DataFrame:
    """edges + bucket: from each bucket of weights (low <= weight < high) `each` edges without replacement, with chances in proportion to their weights.

    Buckets are few, and each sample is a top-n of its own: no bucket is ranked in one task.
    """
    keyed, out = cut(edges.withColumn("key", race(u01(seed, "u", "v"), F.col("weight")))), None
    for name, (low, high) in buckets.items():
        one = keyed.where(weight_bucket(F.col("weight"), F.lit(float(low)), F.lit(float(high)))).orderBy("key", "u", "v").limit(each).drop("key").withColumn("bucket", F.lit(name))
        out = one if out is None else out.union(one)
    return out
