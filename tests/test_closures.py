"""Clustering and ego graphs by blocks of edges, against every triple of nodes in Python."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from eventloom.operators import closures, graph


def _graph(spark, n: int, m: int, seed: int):
    draw = random.Random(seed)
    edges = {(u, v) for u, v in ((int(n * draw.random() ** 2), draw.randrange(n)) for _ in range(m)) if u != v}  # some nodes are hubs
    edges = {(5 * u, 5 * v) for u, v in edges}
    nodes = [(5 * k,) for k in range(n + 3)]  # the last ones have no edge
    return edges, spark.createDataFrame(nodes, "seq_id long"), spark.createDataFrame(sorted(edges), "u long, v long")


@pytest.fixture(params=["whole", "blocks"])
def blocks(request, monkeypatch):
    if request.param == "blocks":
        for name, value in {"SIDE": 3, "SMALLEST": 4, "PACKED": 5, "WEDGES": 7, "MARKS": 60}.items():
            monkeypatch.setattr(closures, name, value)


def test_clustering(spark, blocks):
    edges, nodes, frame = _graph(spark, 24, 170, 1)
    m = {}
    for u, v in edges:
        m[min(u, v), max(u, v)] = m.get((min(u, v), max(u, v)), 0) + 1
    expected = {}
    for k in range(27):
        near = [v for v in range(0, 120, 5) if (min(5 * k, v), max(5 * k, v)) in m]
        of = lambda a, b: m.get((min(a, b), max(a, b)), 0)
        t = sum(of(5 * k, a) * of(5 * k, b) * of(a, b) for a, b in combinations(near, 2))
        d, r = sum(of(5 * k, a) for a in near), sum(of(5 * k, a) == 2 for a in near)
        expected[5 * k] = t / (d * (d - 1) - 2 * r) if d * (d - 1) - 2 * r else 0.0
    assert {r.node: r.clustering for r in graph.clustering(nodes, frame).collect()} == pytest.approx(expected)
    assert 0 < max(expected.values()) < 1


def test_ego_graphs(spark, blocks):
    edges, nodes, frame = _graph(spark, 24, 60, 2)
    out = {5 * k: {v for u, v in edges if u == 5 * k} for k in range(27)}
    assert {r.source: r.size for r in closures.ego_sizes(nodes, frame).collect()} == {u: len({u} | vs | {x for v in vs for x in out[v]}) for u, vs in out.items()}
    among = {s: sum(u in vs | {s} and v in vs | {s} for u, v in edges) for s, vs in out.items()}
    assert {r.source: r.edges for r in closures.ego_edge_counts(frame).collect()} == {s: n for s, n in among.items() if n}


def test_no_edges(spark):
    _, nodes, frame = _graph(spark, 5, 9, 3)
    none = frame.limit(0)
    assert closures.triangles(none).isEmpty() and closures.ego_edge_counts(none).isEmpty()
    assert {r.size for r in closures.ego_sizes(nodes, none).collect()} == {1}


def test_wedges_stay_within_tasks(spark):
    """A hub's pairs of neighbours are rows of no join: edges are sent to tasks, 3 * SIDE times at most, and sums come back."""
    _, nodes, frame = _graph(spark, 24, 170, 1)
    plan = graph.clustering(nodes, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") <= 2  # the sums join the degrees, these the nodes
