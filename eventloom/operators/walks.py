"""Random walks over edges, one join a step, and the contexts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.rand import race, u01
from eventloom.operators.graph import degrees, reverse
from eventloom.runtime import cut

BIASES = ("none", "degree", "edge_weight")


def random_walks(anchors: DataFrame, edges: DataFrame, walks: int, length: int, bias: str = "none", seed: int = 2026, inverted: bool = False) -> DataFrame:
    """(anchor, walk_no, walk array<long>): walks of up to `length` nodes from each anchor (column seq_id), ended at nodes without a way on.

    bias: uniform, in proportion to the next node's degree, or to the edge's weight. inverted: over the edges the other way, each walk turned
    round at the end, so that it goes from the past to the anchor. Each step is a join and a minimum per walk, whose key is an exponential race.
    """
    if bias not in BIASES:
        raise ValueError(f"bias is one of {BIASES}")
    ways = reverse(edges) if inverted else edges
    weight = {"none": F.lit(1.0), "degree": F.col("degree").cast("double"), "edge_weight": F.col("weight") + 1e-6}[bias]
    if bias == "degree":
        ways = ways.join(degrees(edges).select(F.col("node").alias("v"), "degree"), "v")
    ways = cut(ways.select("u", "v", weight.alias("w")))
    live = anchors.select(F.col("seq_id").alias("anchor"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk_no")).withColumn("walk", F.array("anchor"))
    done = None
    for step in range(1, length):
        key = race(u01(seed, "anchor", "walk_no", F.lit(step), "v"), F.col("w"))
        onward = live.join(ways, F.element_at("walk", -1) == ways.u).groupBy("anchor", "walk_no").agg(F.min_by("v", F.struct(key.alias("k"), "v")).alias("next"))
        moved = cut(live.join(onward, ["anchor", "walk_no"], "left"))
        stopped = moved.where("next is null").drop("next")
        done = stopped if done is None else done.union(stopped)
        live = moved.where("next is not null").select("anchor", "walk_no", F.concat("walk", F.array("next")).alias("walk"))
    out = live if done is None else done.union(live)
    return out.withColumn("walk", F.reverse("walk")) if inverted else out


def context_of(walk: str, inverted: bool) -> Column:
    """A walk without its source."""
    return F.slice(walk, 1, F.greatest(F.size(walk) - 1, F.lit(0))) if inverted else F.slice(walk, 2, F.greatest(F.size(walk) - 1, F.lit(0)))


def support_anchors(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 2026) -> DataFrame:
    """(anchor, support, place): each node itself (place 0), then n nodes that are not later than it (itself may be one again), all if there are fewer, drawn for it alone, in proportion to their degrees and without replacement; nodes without edges follow, all alike, where those with edges do not suffice.

    A draw is a place in the degrees' sum up to the anchor's time, and the node that lies there; drawing again on a repeat is drawing without
    replacement. Sums go in the order of time over range partitions. Anchors that lack some draw again, four times as often: the work follows
    the draws, not the pairs of nodes.
    """
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    weighed = nodes.select("seq_id", F.col("when").alias("t")).join(degrees(edges).select(F.col("node").alias("seq_id"), "degree"), "seq_id", "left")
    weighed = weighed.select("seq_id", "t", degree.alias("w"), (degree > 0).cast("long").alias("linked"), (degree == 0).cast("long").alias("alone"))
    dealt = cut(weighed.repartitionByRange("t", "seq_id").withColumn("part", F.spark_partition_id()))
    sums = ("w", "linked", "alone")
    totals = dealt.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in sums))
    inside = Window.partitionBy("part").orderBy("t", "seq_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(dealt.join(totals, "part").select("seq_id", "t", "w", "alone", *((F.col(f"{c}0") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in sums)))
    # All nodes of a time count for each of them.
    times = placed.groupBy("t").agg(*(F.max(f"{c}_upto").alias(f"{c}_all") for c in sums))
    anchors = placed.select(F.col("seq_id").alias("anchor"), "t").join(times, "t").withColumn("first", F.least("linked_all", F.lit(n)))
    anchors = cut(anchors.withColumn("second", F.least(F.lit(n) - F.col("first"), F.col("alone_all"))))
    size = anchors.count()
    out = nodes.select(F.col("seq_id").alias("anchor"), F.col("seq_id").alias("support"), F.lit(0).alias("place"))
    for weight, wanted, after, tag in (("w", "first", F.lit(0), "linked"), ("alone", "second", F.col("first"), "alone")):
        from_ = placed.where(F.col(weight) > 0).select("seq_id", (F.col(f"{weight}_upto") - F.col(weight)).alias("low"), F.col(f"{weight}_upto").alias("upto"))
        lacking = anchors.where(F.col(wanted) > 0).select("anchor", F.col(wanted).alias("wanted"), F.col(f"{weight}_all").alias("whole"), after.alias("after"))
        out = out.union(_supports(from_, lacking, size, 4 * n, u01(seed, F.lit(tag), "anchor", "k")))
    return out


def _supports(places: DataFrame, anchors: DataFrame, size: int, draws: int, draw: Column) -> DataFrame:
    """(anchor, support, place): for each of the anchors (anchor, wanted, whole, after) the first `wanted` different nodes that draws below `whole` hit; places: (seq_id, low, upto)."""
    total = places.agg(F.max("upto")).first()[0] or 1
    # Stretches of the sum meet equal buckets: together no more rows than nodes and buckets.
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(total)) * size)
    stretches = cut(places.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("upto")))))
    lacking, out = cut(anchors), None
    while True:
        drawn = lacking.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("x", F.least(F.floor(draw * F.col("whole")), F.col("whole") - 1))
        found = drawn.withColumn("bucket", bucket("x")).join(stretches, "bucket").where("low <= x and x < upto").groupBy("anchor", "wanted", "after", F.col("seq_id").alias("support")).agg(F.min("k").alias("k"))
        found = cut(found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("k"))).where("place <= wanted"))
        full = cut(found.groupBy("anchor", "wanted").agg(F.count(F.lit(1)).alias("had")).where("had >= wanted").select("anchor"))
        done = found.join(full, "anchor", "left_semi").select("anchor", "support", (F.col("place") + F.col("after")).cast("int").alias("place"))
        out = done if out is None else out.union(done)
        lacking, draws = cut(lacking.join(full, "anchor", "left_anti")), 4 * draws
        if lacking.isEmpty():
            return out


def neighbourhood_walks(nodes: DataFrame, edges: DataFrame, n: int, walks: int, length: int, bias: str = "none", seed: int = 2026, inverted: bool = False) -> DataFrame:
    """(anchor, support, place, walk_no, walk): the walks from each node and from its n support anchors, each without the node that it starts from; walks that are empty then stay.

    Walks are drawn once per node and shared by all that it supports.
    """
    found = random_walks(nodes.select("seq_id"), edges, walks, length, bias, seed, inverted)
    found = found.select(F.col("anchor").alias("support"), "walk_no", context_of("walk", inverted).alias("walk"))
    return support_anchors(nodes, edges, n, seed).join(found, "support").select("anchor", "support", "place", "walk_no", "walk")


def prefix_length(size: Column, draw: Column) -> Column:
    """A cut of a walk: uniform among 1 to size - 1; 1 for sizes up to 2."""
    return F.when(size <= 2, 1).otherwise(1 + F.floor(draw * (size - 1))).cast("int")


def weighted_prefix_length(size: Column, draw: Column, alpha: float) -> Column:
    """A cut with chances in proportion to length ** alpha among 1 to size - 1; 1 for sizes up to 2."""
    powers = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda c: F.pow(c, F.lit(float(alpha))))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    run = F.aggregate(powers, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, x: F.struct((a.s + x).alias("s"), (a.k + F.when(a.s + x <= draw * total, 1).otherwise(0)).alias("k"))).k
    return F.when(size <= 2, 1).otherwise(F.least(1 + run, size - 1)).cast("int")
