"""Steps on edges that must not grow with all of them at once: few are tried, sorted or stored."""

from __future__ import annotations

import random

import numpy as np

from eventloom.operators import graph, removable, sampling, thresholds
from eventloom.runtime import cut


def test_only_the_best_edges_are_tried(spark, monkeypatch):
    from tests.test_exact_draws import brute_removable

    rng, n = random.Random(8), 24
    pairs = rng.sample([(u, v) for u in range(n) for v in range(u + 1, n)], 120)
    edges = [(u, v, rng.randint(1, 30) / 32) for u, v in pairs]
    frame, sizes, forest = spark.createDataFrame(edges, "u long, v long, weight double"), [], removable.late_forest
    monkeypatch.setattr(removable, "FIRST", 8)
    monkeypatch.setattr(removable, "EACH", 2)
    monkeypatch.setattr(removable, "late_forest", lambda nodes, kept, open_: (sizes.append(open_.count()), forest(nodes, kept, open_))[1])
    for k in (3, 40):  # 40: more edges have to be tried
        found = removable.removable_edges(spark.range(n).withColumnRenamed("id", "seq_id"), frame, k)
        assert sorted((r.u, r.v) for r in found.collect()) == sorted(brute_removable(n, edges, k))
        if k == 3:
            assert max(sizes) <= 8


def test_weights_are_not_sorted_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(thresholds, "HOT", 50)
    w = np.random.default_rng(3).normal(size=500)
    frame = cut(spark.createDataFrame([(float(x),) for x in w], "weight double"))
    found = sampling.weight_summary(frame)
    assert "percentile" not in found._jdf.queryExecution().toString().lower()
    row = found.first()
    assert row.n == 500 and np.allclose([row.mean, row.median, row.std, row.min, row.max, row.q1, row.q3, row.p90], [w.mean(), np.median(w), w.std(), w.min(), w.max(), *np.quantile(w, (0.25, 0.75, 0.9))])
    assert tuple(sampling.weight_summary(frame.limit(0)).first())[:2] == (0, None)


def test_degrees_read_edges_once(spark):
    edges = cut(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "u long, v long"))
    found = graph.degrees(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    assert {tuple(r) for r in found.collect()} == {(0, 2, 0, 2), (1, 1, 1, 2), (2, 0, 2, 2)}


def test_tiles_are_not_sent_to_each_tile_they_meet(spark, monkeypatch):
    from dataclasses import replace

    from eventloom.operators import bridges
    from eventloom.plans.event_graph import GraphConfig
    from tests.test_bounds import nodes

    monkeypatch.setattr(bridges, "TILE", 8)
    asked, best_of, report = [], bridges._best_of, {}
    monkeypatch.setattr(bridges, "_best_of", lambda tiles, pairs, config: (asked.append(pairs.count()), best_of(tiles, pairs, config))[1])
    frame = spark.createDataFrame(nodes(5, 400, 400, missing=False), "seq_id long, what_vec array<double>, when timestamp, lat double, lon double, rank long")
    assert bridges.bounded_bridges(frame, replace(GraphConfig("what"), directed=False), report).count() > 0
    assert sum(asked) <= 3 * report["tiles"] < report["met"]
    one = frame.withColumn("rank", frame.rank * 0)
    assert bridges.bounded_bridges(one, GraphConfig("what"), report).count() == 0 and report["met"] == 0  # a single component
