"""The event graph: pairs, similarity edges over per-node thresholds, bridges between components."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.similarity import CONVERSIONS, FUSIONS
from eventloom.operators.bridges import bounded_bridges
from eventloom.operators.components import components
from eventloom.operators.pairs import event_pairs
from eventloom.operators.prepare import renumber
from eventloom.operators.selection import SHARES, best_edges
from eventloom.operators.thresholds import METHODS, thresholds
from eventloom.operators.tiles import Tiles, Weighing, edges_above
from eventloom.operators.tiles import thresholds as tile_thresholds
from eventloom.runtime import cut

FOREVER = float("inf")


@dataclass(frozen=True)
class GraphConfig:
    """How pairs are weighed, which pairs may be edges, and how each node's threshold is set."""

    similarity: str = "multiply"
    filter_type: str = "iqr"
    threshold: float = 1.5
    what_range: tuple[float, float] = (0.0, 1.0)
    where_range: tuple[float, float] = (0.0, FOREVER)
    when_range: tuple[float, float] = (0.0, FOREVER)
    where_conversion: str = "inverse"
    when_conversion: str = "inverse"
    where_args: dict = field(default_factory=dict)
    when_args: dict = field(default_factory=dict)
    max_neighbors: int | None = None
    directed: bool = True
    positive_only: bool = True

    def __post_init__(self) -> None:
        for value, allowed in ((self.similarity, FUSIONS), (self.filter_type, METHODS), (self.where_conversion, CONVERSIONS), (self.when_conversion, CONVERSIONS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {sorted(allowed)}")


#: The shipped setting: semantic similarity alone, MAD threshold, a month's window, 100 neighbours.
NEWS = GraphConfig("what", "mad", 3.0, what_range=(0.1, 1.0), where_range=(0.0, 1e4), when_range=(0.0, 31.0), max_neighbors=100)


def weighed_pairs(nodes: DataFrame, config: GraphConfig, within: bool = True) -> DataFrame:
    """(u, v, weight_all, weight, what_sim, where_sim, when_sim): every allowed direction of every pair.

    weight_all is the fused similarity, weight the same where all ranges hold and else 0. within: only pairs inside the time window are made,
    enough for edges and for thresholds, which know of the others without seeing them.
    """
    pairs = event_pairs(nodes, config.when_range[1] if within else None)
    pairs = pairs.withColumn("where_sim", CONVERSIONS[config.where_conversion](F.col("km"), **config.where_args)).withColumn("when_sim", CONVERSIONS[config.when_conversion](F.col("days"), **config.when_args))
    allowed = F.lit(True)
    for col, (low, high) in (("what_sim", config.what_range), ("km", config.where_range), ("days", config.when_range)):
        allowed = allowed & (F.col(col) >= low) & (F.col(col) <= high)
    fused = FUSIONS[config.similarity](F.col("what_sim"), F.col("where_sim"), F.col("when_sim"))
    pairs = pairs.select("u", "v", fused.alias("weight_all"), F.when(allowed, fused).otherwise(0.0).alias("weight"), "what_sim", "where_sim", "when_sim")
    return pairs if config.directed else pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight_all", "weight", "what_sim", "where_sim", "when_sim"))


def similarity_edges(pairs: DataFrame, config: GraphConfig, n_nodes: int | None = None) -> DataFrame:
    """Each node's outgoing pairs at or above its own threshold, the best max_neighbors of them; undirected: each edge once, from the smaller node.

    positive_only: thresholds are of a node's positive weights. Else they are of its weights to all n_nodes nodes, itself included: whatever is out of
    range, out of the window or against the direction weighs 0 and counts, without being stored. Pairs of weight 0 are no edges in either case.
    """
    live = cut(pairs.where("weight > 0") if config.positive_only else pairs.where("weight <> 0"))
    zeros = None
    if not config.positive_only:
        if n_nodes is None:
            raise ValueError("thresholds over all weights need the number of nodes")
        zeros = live.groupBy("u").agg((F.lit(n_nodes) - F.count(F.lit(1))).alias("z"))
    kept = live.join(thresholds(live, config.filter_type, config.threshold, zeros=zeros), "u").where("weight >= threshold")
    if config.max_neighbors is not None:
        best = Window.partitionBy("u").orderBy(F.desc("weight"), F.desc("v"))
        kept = kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= config.max_neighbors)
    return _as_edges(kept, config)


def _as_edges(kept: DataFrame, config: GraphConfig) -> DataFrame:
    columns = ["u", "v", "weight", "what_sim", "where_sim", "when_sim"]
    if config.directed:
        return kept.select(*columns, F.lit("similarity").alias("edge_type"))
    ends = kept.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), *columns[2:])
    return ends.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in columns[2:]]).select(F.col("a").alias("u"), F.col("b").alias("v"), *columns[2:], F.lit("similarity").alias("edge_type"))


def graph_edges(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """similarity_edges(weighed_pairs(nodes, config), config, nodes.count()), without a table of pairs: tasks weigh them again for each step of the thresholds."""
    ranges = {c: getattr(config, c) for c in ("similarity", "what_range", "where_range", "when_range", "where_conversion", "when_conversion", "where_args", "when_args", "directed", "positive_only")}
    tiles = Tiles(nodes, Weighing(**ranges))
    if config.positive_only and config.filter_type in SHARES:
        return _as_edges(best_edges(tiles, config.filter_type, config.threshold, config.max_neighbors), config)
    limits = tile_thresholds(tiles, {config.filter_type: config.threshold}, None if config.positive_only else nodes.count())
    limits = cut(limits.select("u", F.col(config.filter_type).alias("threshold")))
    return _as_edges(edges_above(tiles, limits, config.max_neighbors), config)


def bridge_edges(nodes: DataFrame, edges: DataFrame, config: GraphConfig) -> DataFrame:
    """One edge to each component but the largest, from the union of the larger ones: the pair of highest unconstrained similarity.

    Components are ranked by size, then by smallest node. Joining the two largest again and again always adds the next one of this order, so every
    component's bridge can be chosen alone. Where direction forbids every pair, its similarity counts as 0, and the smallest numbers win.
    """
    member = cut(components(nodes, edges))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rank = renumber(sizes.select("component", F.struct((-F.col("size")).alias("size"), "component").alias("place")), "place", "rank")
    best = bounded_bridges(nodes.join(member.join(rank, "component").select("seq_id", "rank"), "seq_id"), config)
    return best.select("u", "v", "weight", "what_sim", "where_sim", "when_sim", F.lit("component_bridge").alias("edge_type"))


def build_graph(nodes: DataFrame, config: GraphConfig = NEWS) -> DataFrame:
    """All edges of the event graph of nodes (seq_id, what_vec, when, lat, lon)."""
    nodes = cut(nodes)
    edges = cut(graph_edges(nodes, config))
    return edges.union(bridge_edges(nodes, edges, config))
