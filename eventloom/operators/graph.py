"""Measures and derivations of a graph held as edges (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.closures import triangles
from eventloom.runtime import cut


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge the other way round."""
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, each once."""
    return edges.select("u", "v").union(edges.select("v", "u")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) of every node that has an edge."""
    end = lambda c, o: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("end")).select("end.*")  # edges are read once
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges, bridge_share, density, avg_degree, max_degree of a directed graph."""
    e = edges.agg(F.count(F.lit(1)).alias("num_edges"), F.avg((F.col("edge_type") == "component_bridge").cast("double")).alias("bridge_share"))
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    d = degrees(edges).agg(F.max("degree").alias("max_degree"))
    one = n.crossJoin(e).crossJoin(d)  # single rows
    size = F.col("num_nodes")
    return one.select("num_nodes", "num_edges", "bridge_share", (F.col("num_edges") / (size * (size - 1))).alias("density"), (2 * F.col("num_edges") / size).alias("avg_degree"), "max_degree")


def clustering(nodes: DataFrame, edges: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(node, clustering): directed clustering coefficient: triangles through a node over 2 (d (d - 1) - 2 r), d its degree and r its reciprocal edges; 0 where that is 0.

    Triangles are found over the neighbour with the smaller degree, so that a hub's neighbours are not paired with each other, and within tasks.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("m"))  # m: 2 where edges go both ways
    deg = both.groupBy("u").agg(F.sum("m").alias("d"), F.sum((F.col("m") == 2).cast("long")).alias("r"))
    size = deg.select("u", F.struct("d", "u").alias("rank"))
    ranked = both.join(size, "u").join(size.select(F.col("u").alias("v"), F.col("rank").alias("rank_v")), "v")
    up = cut(ranked.where("rank < rank_v").select("u", "v", "m"))
    at = triangles(up, "m").withColumnRenamed("node", "u")
    whole = deg.join(at, "u", "left").withColumn("den", 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r")))
    # The sum over ordered triples of (A + A')^3 counts each triangle of this orientation twice.
    value = F.when(F.col("den") > 0, 2 * F.coalesce("t", F.lit(0)) / F.col("den")).otherwise(0.0)
    return nodes.select(F.col(id_col).alias("node")).join(whole.select(F.col("u").alias("node"), value.alias("clustering")), "node", "left").fillna({"clustering": 0.0})


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: the correlation of the source's out-degree with the target's in-degree over edges."""
    d = degrees(edges)
    ends = edges.join(d.select(F.col("node").alias("u"), "out_degree"), "u").join(d.select(F.col("node").alias("v"), "in_degree"), "v")
    return ends.agg(F.corr("out_degree", "in_degree").alias("assortativity"))


def shortest_paths(nodes: DataFrame, edges: DataFrame, id_col: str = "seq_id", most: int | None = None) -> DataFrame:
    """(source, node, dist): lengths of all shortest directed paths, 0 to itself included; most: no longer ones."""
    hops = cut(edges.select("u", "v").distinct())
    front = nodes.select(F.col(id_col).alias("source"), F.col(id_col).alias("node"))
    found, step = cut(front.withColumn("dist", F.lit(0))), 0  # the union of all fronts: each is stored once
    front = found.select("source", "node")
    while most is None or step < most:
        step += 1
        reached = front.join(hops, front.node == hops.u).select("source", F.col("v").alias("node")).distinct()
        front = cut(reached.join(found.select("source", "node"), ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front.withColumn("dist", F.lit(step)))
    return found


def path_summary(paths: DataFrame) -> DataFrame:
    """One row: mean and maximum of all path lengths, self-distances included."""
    return paths.agg(F.avg("dist").alias("avg_shortest_path_length"), F.max("dist").alias("max_shortest_path_length"))


def ego(nodes: DataFrame, edges: DataFrame, radius: int, id_col: str = "seq_id") -> DataFrame:
    """(source, node): each node's neighbourhood within `radius` out-steps, itself included."""
    return shortest_paths(nodes, edges, id_col, radius).select("source", "node")


def train_graph(nodes: DataFrame, edges: DataFrame, targets: DataFrame, id_col: str = "seq_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the target nodes (column v) of positive test edges."""
    gone = targets.select("v").distinct()
    left = nodes.join(gone, nodes[id_col] == gone.v, "left_anti")
    kept = edges.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti")
    return left, kept.select(*edges.columns)


def undirected_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: density of the graph without directions, parallel edges and loops counted out."""
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct().agg(F.count(F.lit(1)).alias("m"))
    return nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(pairs).select(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)).alias("density"))  # single rows


def diameter(nodes: DataFrame, edges: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """One row: the longest shortest path of the graph without directions; null if some nodes do not reach each other."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    paths = shortest_paths(nodes, both, id_col)
    whole = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(paths.agg(F.max("dist").alias("longest"), F.count(F.lit(1)).alias("reached")))  # single rows
    return whole.select(F.when(F.col("reached") == F.col("n") * F.col("n"), F.col("longest")).alias("diameter"), (F.col("reached") / (F.col("n") * F.col("n"))).alias("reached_share"))


def induced(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (source, node) -> (source, u, v): the edges between nodes of the same group, as of ego graphs."""
    return groups.select("source", F.col("node").alias("u")).join(edges.select("u", "v"), "u").join(groups.select("source", F.col("node").alias("v")), ["source", "v"]).select("source", "u", "v")


def latest_edges(nodes: DataFrame, edges: DataFrame, k: int, id_col: str = "seq_id") -> DataFrame:
    """The k edges of the latest target nodes, ties by u, v."""
    times = nodes.select(F.col(id_col).alias("v"), F.col("when").alias("_when"))
    return edges.join(times, "v").orderBy(F.desc("_when"), "u", "v").limit(k).select(*edges.columns)


def top_edges(edges: DataFrame, k: int, attribute: str = "weight") -> DataFrame:
    """The k edges of the highest attribute, ties by u then v."""
    if attribute not in ("weight", "what_sim", "where_sim", "when_sim"):
        raise ValueError(f"cannot sort edges by {attribute!r}")
    return edges.orderBy(F.desc(attribute), "u", "v").limit(k)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 5, id_col: str = "seq_id") -> DataFrame:
    """(id_col, community): weighted label propagation, each round every node taking the label that weighs most among its neighbours, ties to the smaller label."""
    both = cut(edges.select("u", "v", "weight").union(edges.select("v", "u", "weight")))
    labels = nodes.select(F.col(id_col).alias("v"), F.col(id_col).alias("label"))
    for _ in range(rounds):
        votes = both.join(labels, "v").groupBy("u", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        won = votes.groupBy("u").agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("n"))).alias("new"))
        labels = cut(labels.join(won, labels.v == won.u, "left").select("v", F.coalesce("new", "label").alias("label")))
    return labels.select(F.col("v").alias(id_col), F.col("label").alias("community"))
