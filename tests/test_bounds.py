"""Bridges by bounds, exact selection and implied zeros, against brute force."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.similarity import FUSIONS, NUMPY_CONVERSIONS
from eventloom.operators import bridges, pairs, thresholds
from eventloom.plans.event_graph import GraphConfig, similarity_edges
from eventloom.runtime import cut

DAY = datetime(2026, 3, 1)


def brute(rows, config):
    best = {}
    for x in rows:
        for y in rows:
            if x["rank"] >= y["rank"] or x["when"] is None or y["when"] is None:
                continue
            what = float(np.dot(x["what_vec"], y["what_vec"]))
            lat, lon = np.radians([x["lat"], y["lat"]]), np.radians([x["lon"], y["lon"]])
            h = np.sin((lat[1] - lat[0]) / 2) ** 2 + np.cos(lat[0]) * np.cos(lat[1]) * np.sin((lon[1] - lon[0]) / 2) ** 2
            km, days = int(2 * 6371.0088 * np.arcsin(np.sqrt(min(h, 1.0)))), abs((x["when"].date() - y["when"].date()).days)
            where, when = NUMPY_CONVERSIONS[config.where_conversion](km, **config.where_args), NUMPY_CONVERSIONS[config.when_conversion](days, **config.when_args)
            w = FUSIONS[config.similarity](what, where, when)
            if config.directed and not (x["when"] < y["when"] or x["when"] == y["when"] and x["seq_id"] > y["seq_id"]):
                w = 0.0
            key = (-round(w, 9), x["seq_id"], y["seq_id"])
            if y["rank"] not in best or key < best[y["rank"]]:
                best[y["rank"]] = key
    return {r: k for r, k in best.items()}


def nodes(seed, n, groups, missing=True):
    rng, r = random.Random(seed), np.random.default_rng(seed)
    centres = r.normal(size=(groups, 8))
    out = []
    for k in range(n):
        v = centres[rng.randrange(groups)] * 3 + r.normal(size=8) * 0.3
        v = v / np.linalg.norm(v)
        when = None if missing and rng.random() < 0.02 else DAY + timedelta(hours=rng.randrange(2000))
        rank = rng.choice([0, 0, 0, rng.randrange(1, max(2, n // 3))])
        out.append({"seq_id": k, "what_vec": v.tolist(), "when": when, "lat": rng.uniform(-80, 80), "lon": rng.uniform(-180, 180), "rank": rank})
    return out


CONFIGS = [GraphConfig("what"), GraphConfig("multiply", where_conversion="linear", where_args={"max_distance": 5000}), GraphConfig("sum", when_conversion="exponential", when_args={"alpha": 30.0}, directed=False)]


@pytest.mark.parametrize("config", CONFIGS)
def test_bridges_against_all_pairs(spark, config, monkeypatch):
    monkeypatch.setattr(bridges, "TILE", 8)
    rows = nodes(3, 150, 5)
    frame = spark.createDataFrame(rows, "seq_id long, what_vec array<double>, when timestamp, lat double, lon double, rank long")
    got = {r.rv: (-round(r.weight, 9), r.u, r.v) for r in bridges.bounded_bridges(frame, config).collect()}
    want = brute(rows, config)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-8 for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # ties to the last bit may fall otherwise


def test_most_pairs_of_tiles_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(bridges, "TILE", 16)
    rows, report = nodes(5, 1200, 40, missing=False), {}
    frame = spark.createDataFrame(rows, "seq_id long, what_vec array<double>, when timestamp, lat double, lon double, rank long")
    found = bridges.bounded_bridges(frame, replace(GraphConfig("what"), directed=False), report).count()
    assert found == len({r["rank"] for r in rows}) - 1
    assert report["met"] < 0.5 * report["pairs"], report


def test_bounds_hold():
    r = np.random.default_rng(2)
    rows = nodes(8, 120, 6, missing=False)
    for config in CONFIGS:
        a, b = {}, {}
        for side, part in ((a, rows[:60]), (b, rows[60:])):
            x, day = np.array([p["what_vec"] for p in part]), np.array([(p["when"] - DAY).days for p in part])
            points = bridges._unit(np.array([p["lat"] for p in part]), np.array([p["lon"] for p in part]))
            place = points.sum(axis=0) / np.linalg.norm(points.sum(axis=0))
            side |= {"centre": x.mean(axis=0)[None], "radius": np.array([np.linalg.norm(x - x.mean(axis=0), axis=1).max()]), "place": place[None], "spread": np.array([np.arccos(np.clip(points @ place, -1, 1)).max()]), "day0": np.array([day.min()]), "day1": np.array([day.max()])}
        bound = bridges.pair_bounds(a, b, config)[0, 0]
        free = SimpleNamespace(**{**config.__dict__, "directed": False})
        for k in r.integers(0, 60, 200):
            pair = [dict(rows[k], rank=0), dict(rows[60 + k], rank=1)]
            assert -brute(pair, free)[1][0] <= bound + 1e-8


def test_selection_of_large_keys(spark, monkeypatch):
    rng = random.Random(4)
    data = {"a": [rng.choice([-1e300, -3.5, -0.0, 0.0, 1e-310, 2.0, rng.gauss(0, 1), rng.gauss(0, 1e8)]) for _ in range(900)], "b": [rng.random() for _ in range(301)], "c": [7.0] * 400, "d": [1.0, 2.0]}
    frame = cut(spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "key string, value double"))
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    want = {k: np.quantile(np.array(v), shares) for k, v in data.items()}
    for hot in (100, 10**6):
        monkeypatch.setattr(thresholds, "HOT", hot)
        got = {r.key: r.q for r in thresholds.quantiles(frame, shares).collect()}
        assert set(got) == set(data) and all(np.allclose(got[k], want[k], rtol=1e-12) for k in data)
    monkeypatch.setattr(thresholds, "HOT", 100)
    implied = spark.createDataFrame([("a", 0.0, 500), ("b", 0.5, 77), ("e", 0.0, 3)], "key string, c double, z long")
    got = {r.key: r.q for r in thresholds.quantiles(frame, shares, implied).collect()}
    want = {k: np.quantile(np.array(data.get(k, []) + [c] * z), shares) for k, c, z in (("a", 0.0, 500), ("b", 0.5, 77), ("e", 0.0, 3), ("c", 0.0, 0), ("d", 0.0, 0))}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_edges_over_all_weights_of_a_node(spark):
    weights = [0.2, 0.4, 0.9]
    frame = spark.createDataFrame([(0, k + 1, w, w, 1.0, 1.0) for k, w in enumerate(weights)] + [(0, 9, 0.0, 0.0, 1.0, 1.0)], "u long, v long, weight double, what_sim double, where_sim double, when_sim double")
    for share, over_all, over_positive in ((75.0, 3, 1), (50.0, 3, 2), (90.0, 1, 1)):
        config = GraphConfig("what", "percentile", share, positive_only=False)
        assert similarity_edges(frame, config, 9).count() == over_all == sum(w >= np.quantile([0.0] * 6 + weights, share / 100) for w in weights)
        assert similarity_edges(frame, replace(config, positive_only=True)).count() == over_positive
    with pytest.raises(ValueError):
        similarity_edges(frame, GraphConfig(positive_only=False))


def test_size_estimates_stay_small(spark):
    frame = cut(spark.range(20).withColumn("k", F.col("id") % 3))
    for _ in range(14):
        frame = cut(frame.join(frame.select("k", F.col("id").alias("other")).limit(5), "k").select("id", "k").distinct())
    assert int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() <= 1024
    assert frame.count() <= 20 and pairs.TILE == 256
