"""Edges in two passes, against the table of all pairs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from eventloom.operators import selection, tiles
from eventloom.plans import event_graph
from eventloom.plans.event_graph import GraphConfig, graph_edges, similarity_edges, weighed_pairs
from tests.test_tiles import _edges, _nodes

CONFIGS = [
    GraphConfig("what", "mad", 0.5, what_range=(0.1, 0.9), where_range=(0.0, 1e4), when_range=(0.0, 7.0), max_neighbors=4),
    GraphConfig("what", "mad", -0.4, what_range=(0.1, 1.0), directed=False, max_neighbors=6), GraphConfig("multiply", "mad", 1.0),
    GraphConfig("multiply", "iqr", 0.2), GraphConfig("what", "iqr", -0.3, max_neighbors=7), GraphConfig("sum", "percentile", 80.0, max_neighbors=3),
]


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("constants", [{"SAMPLE": 9, "EVEN": 5, "TAIL": 3, "BAND": 8, "MANY": 4}, {"SAMPLE": 30, "EVEN": 16, "CELLS": 32}])
def test_the_edges_are_those_of_the_table_of_pairs(spark, monkeypatch, config, constants):
    """Also where the bins are coarse, made of few nodes, or most nodes have too many weights in theirs."""
    nodes = _nodes(spark, 90, 3)
    expected = _edges(similarity_edges(weighed_pairs(nodes, config), config, nodes.count()))
    assert expected
    monkeypatch.setattr(tiles, "SMALLEST", 17)
    monkeypatch.setattr(tiles, "STRIP", 90)
    for name, value in constants.items():
        monkeypatch.setattr(selection, name, value)
    assert _edges(graph_edges(nodes, config)) == expected


@pytest.mark.parametrize("many", [3, 8192])
def test_equal_weights(spark, monkeypatch, many):
    config = replace(CONFIGS[0], what_range=(0.1, 99.0), threshold=0.0, where_range=(0.0, 1e5))
    nodes = _nodes(spark, 60, 5, 3, coarse=True)
    monkeypatch.setattr(selection, "MANY", many)
    assert _edges(graph_edges(nodes, config)) == _edges(similarity_edges(weighed_pairs(nodes, config), config))


def test_all_pairs_are_weighed_twice(spark, monkeypatch):
    """Once to count, once to send what is left; the moments and the narrowing ranges of every node took some eight passes."""
    passes, each = [], tiles.Tiles.each
    monkeypatch.setattr(tiles.Tiles, "each", lambda self, *args, **more: passes.append(1) or each(self, *args, **more))
    assert event_graph.graph_edges(_nodes(spark, 300, 4), CONFIGS[0]).count()
    assert len(passes) == 2


def test_bins_hold_every_weight_in_order():
    rng = np.random.default_rng(1)
    for x in (np.exp(rng.normal(size=5000) * 8), np.round(rng.random(3000), 2) + 0.1, np.zeros(0), np.full(7, 0.3)):
        bins = selection.Bins.of(x)
        probe = np.concatenate((x, bins.edges, np.nextafter(bins.edges, 0), [1e-300, 1e200]))
        k = bins(probe)
        assert (bins.low[k] <= probe).all() and (probe < bins.high[k]).all() and len(bins.cell) <= selection.CELLS
