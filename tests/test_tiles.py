"""Thresholds, edges and sums over pairs that are never written, against the table of all pairs."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import tiles
from eventloom.operators.pairs import event_pairs
from eventloom.plans.event_graph import GraphConfig, graph_edges, similarity_edges, weighed_pairs


def _nodes(spark, n: int, seed: int, width: int = 6, coarse: bool = False):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        vec = rng.normal(size=width)
        vec = np.round(vec) if coarse else vec / np.linalg.norm(vec)
        when = None if k % 29 == 5 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 300)))
        rows.append((k * 3, None if k % 31 == 7 else vec.tolist(), when, None if k % 23 == 3 else float(rng.integers(-80, 80)), float(rng.integers(-170, 170))))
    return spark.createDataFrame(rows, "seq_id long, what_vec array<double>, when timestamp, lat double, lon double")


def _edges(frame):
    return sorted((r.u, r.v, round(r.weight, 9), round(r.where_sim, 9), round(r.when_sim, 9)) for r in frame.collect())


CONFIGS = [
    GraphConfig("what", "mad", 0.5, what_range=(0.1, 1.0), where_range=(0.0, 1e4), when_range=(0.0, 7.0), max_neighbors=4),
    GraphConfig("multiply", "iqr", 0.2), GraphConfig("what", "percentile", 80.0, what_range=(-1.0, 1.0), positive_only=False, directed=False), GraphConfig("what", "mad", 0.3, what_range=(-1.0, 1.0), positive_only=False),
    GraphConfig("sum", "zscore", 0.5, when_range=(2.0, 9.0), directed=False, max_neighbors=3, where_conversion="exponential", where_args={"alpha": 1000.0}),
]


@pytest.mark.parametrize("config", CONFIGS)
def test_edges_without_a_table_of_pairs(spark, monkeypatch, config):
    nodes = _nodes(spark, 90, 3)
    expected = _edges(similarity_edges(weighed_pairs(nodes, config), config, nodes.count()))
    assert expected
    monkeypatch.setattr("eventloom.plans.event_graph.event_pairs", None)  # nobody may ask for the pairs
    for name, value in {"SMALLEST": 7, "PARTS": 4, "BINS": 4, "MOST": 3, "BAND": 8}.items():
        monkeypatch.setattr(tiles, name, value)
    assert _edges(graph_edges(nodes, config)) == expected


def test_ties_and_many_equal_weights(spark, monkeypatch):
    nodes, config = _nodes(spark, 60, 5, 3, coarse=True), replace(CONFIGS[0], what_range=(0.1, 99.0), threshold=0.0, where_range=(0.0, 1e5))
    expected = _edges(similarity_edges(weighed_pairs(nodes, config), config))
    for name, value in {"SMALLEST": 16, "MOST": 1, "BINS": 4, "ROUNDS": 3}.items():
        monkeypatch.setattr(tiles, name, value)
    assert _edges(graph_edges(nodes, config)) == expected and len(expected) > 20


def test_strips_hold_the_same_pairs_whatever_their_size(spark, monkeypatch):
    rows = tiles.Tiles(_nodes(spark, 80, 2), tiles.Weighing("multiply")).base.toArrow()
    a, b = tiles.Side(rows.slice(0, 30)), tiles.Side(rows.slice(30))
    pairs = lambda: [(i, j, x) for s in tiles.strips(a, b, False, tiles.Weighing("multiply")) for i, j, x in zip(s.i, s.j, s.weight, strict=True)]
    whole = pairs()
    for name, value in (("STRIP", 90), ("PLACES", 0)):
        monkeypatch.setattr(tiles, name, value)
        assert [p[:2] for p in pairs()] == [p[:2] for p in whole] and np.allclose([p[2] for p in pairs()], [p[2] for p in whole])


def test_a_node_is_sent_as_often_as_there_are_tiles(spark):
    """The tiles grow with the table: their number, and with it how often a node is sent, does not."""
    for n in (300, 2000):
        found = tiles.Tiles(_nodes(spark, n, 1), tiles.Weighing())
        assert found.base.select("tile").distinct().count() <= tiles.PARTS and found.met.count() <= tiles.PARTS * (tiles.PARTS + 1) / 2


@pytest.mark.parametrize("bins", [4, 128])
def test_thresholds_over_all_pairs(spark, monkeypatch, bins):
    """One row over the weights of all pairs, by each method, as numpy has them."""
    nodes = _nodes(spark, 70, 9)
    monkeypatch.setattr(tiles, "BINS", bins)
    monkeypatch.setattr(tiles, "MOST", 5)
    laid = tiles.Tiles(nodes, tiles.Weighing())
    rows = [r for r in nodes.collect() if r.when is not None and r.what_vec is not None]
    x = np.array([np.dot(a.what_vec, b.what_vec) for k, a in enumerate(rows) for b in rows[:k]])
    x = x[x > 0]
    q1, mid, q3, p = np.quantile(x, [0.25, 0.5, 0.75, 0.95])
    expected = {"zscore": x.mean() + 2 * x.std(), "iqr": q3 + 3 * (q3 - q1), "percentile": p, "mad": mid + 3.5 * np.median(np.abs(x - mid)) / 0.6745}
    found = tiles.thresholds(laid, {"zscore": 2.0, "iqr": 3.0, "percentile": 95.0, "mad": 3.5}, whole=True).drop("u").first().asDict()
    assert found == pytest.approx(expected)
    assert tiles.counts_above(laid, list(expected.values())[:3]) == [int((x >= t).sum()) for t in list(expected.values())[:3]]


def test_sums_and_extremes_of_all_pairs(spark):
    """Each node's sum over its pairs and the most and least alike pairs, unknown similarities left out, as the table of all pairs gives them."""
    nodes = _nodes(spark, 60, 4)
    pairs = [r for r in weighed_pairs(nodes, GraphConfig("multiply", what_range=(-9.0, 9.0))).collect()]
    laid = tiles.Tiles(nodes, tiles.Weighing("multiply", what_range=None))
    expected = {}
    for r in pairs:
        expected.setdefault(r.u, []).append(r.weight_all)
    found = {r.u: r.multiply for r in tiles.sums(laid, {"multiply": lambda s: s.weight}).collect()}
    assert found.keys() == expected.keys()
    for u, xs in expected.items():
        known = [x for x in xs if x is not None]
        assert found[u] == (pytest.approx(sum(known)) if known else None)
    sims = [r.what_sim for r in pairs if r.what_sim is not None]
    ends = [r.what_sim for r in tiles.extremes(laid).collect()]
    assert max(ends) == pytest.approx(max(sims)) and min(ends) == pytest.approx(min(sims))


def test_sums_of_distances_by_places(spark, monkeypatch):
    """Places and days meet instead of nodes, without vectors: the same sums as over all pairs."""
    nodes = _nodes(spark, 90, 6).withColumns({"lat": F.round(F.col("lat") / 40) * 40, "lon": F.round(F.col("lon") / 90) * 90})  # many at one place
    inverse, days = (lambda d: 1 / (1 + d)), (lambda d: np.exp(-d / 2.0))
    expected = {}
    for r in event_pairs(nodes.where("when is not null")).collect():
        expected.setdefault(r.u, []).append((np.nan if r.km is None else float(r.km), float(r.days)))
    for name, value in {"SMALLEST": 13, "PARTS": 5, "STRIP": 50}.items():
        monkeypatch.setattr(tiles, name, value)
    laid = tiles.Tiles(nodes, tiles.Weighing(), vectors=False)
    assert "what_vec" not in laid.base.columns
    found = {r.u: r for r in tiles.distance_sums(laid, {"km": inverse}, {"days": days}).collect()}
    assert found.keys() == expected.keys()
    for u, d in expected.items():
        km, apart = np.array(d).T
        known = ~np.isnan(km)
        assert found[u].days == pytest.approx(days(apart).sum()) and found[u].km == (pytest.approx(inverse(km[known]).sum()) if known.any() else None)


def test_only_times_and_places_travel(spark, tmp_path, monkeypatch):
    """Queries on times and places store no vectors, and of the events only those that can meet a vector are sent to the join."""
    from eventloom.plans.queries import QUERIES
    from eventloom.plans.views import ev_nodes

    for n, m in ((40, 6), (3, 6)):  # fewer events than vectors too
        folder = str(tmp_path / f"{n}")
        spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("ts"), F.col("id").alias("user_id"), F.lit("a").alias("event_type"), F.lit("b").alias("props")).write.parquet(f"{folder}/events.parquet")
        spark.range(m).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 1.0).cast("array<float>").alias("embedding")).write.parquet(f"{folder}/embeddings.parquet")
        found = ev_nodes(spark, folder)
        assert {(r.seq_id, r.who) for r in found.collect()} == {(k, k * (n // m)) for k in range(m)}
        assert f"% {n // m}) = 0" in found._jdf.queryExecution().optimizedPlan().toString() or n < m
        stored, keep = [], tiles.cut
        monkeypatch.setattr(tiles, "cut", lambda df: (stored.append(df.columns), keep(df))[1])
        for name in ("newer_mask_counts", "distance_conversions"):
            assert QUERIES[name](spark, folder).count() == m - 1
        monkeypatch.setattr(tiles, "cut", keep)
        assert stored and not any("what_vec" in columns for columns in stored)
