"""Embedding near-dedup on vectors of low rank, whose near pairs differ in few directions."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from eventloom.llm import embedding_dedup


@pytest.mark.parametrize("rank", [4, 8])
def test_low_rank_clusters_lose_no_link(spark, monkeypatch, rank):
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    rng = np.random.default_rng(rank)
    centres = rng.standard_normal((40, rank))
    x = (centres[rng.integers(0, 40, 1500)] + 0.25 * rng.standard_normal((1500, rank))) @ rng.standard_normal((rank, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = u @ u.T
    near = cosines >= 0.95
    assert np.abs(cosines - 0.95).min() > 1e-9 and near.sum() > 10 * len(x)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(rows).collect()}
    assert [got[k] for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()


def test_multi_sequence_is_in_order_and_complete():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 7), (20, 5)):
        first, second = np.sort(rng.random(n)), np.sort(rng.random(m))
        for reach in (0.0, 0.3, 0.9, 3.0):
            met = embedding_dedup.multi_sequence(first.tolist(), second.tolist(), reach)
            sums = [first[i] + second[j] for i, j in met]
            assert sums == sorted(sums) and set(met) == {(i, j) for i in range(n) for j in range(m) if first[i] + second[j] <= reach}
    assert embedding_dedup.multi_sequence([], [0.1], 1.0) == []


@pytest.mark.parametrize("target", [0.9, 0.99])
def test_lower_target_visits_fewer_cells_and_keeps_its_recall(target):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 32))
    x = np.concatenate((base, base + 0.2 * rng.standard_normal((3000, 32))))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    whole, less = (embedding_dedup.fit_grid(u[::2], 400_000, 0.95, t) for t in (1.0, target))
    assert less.reach < whole.reach
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    cell, ga, gb = less.locate(u)
    n = len(less.second)
    meet = np.where(cell[b] >= cell[a], ga[a, cell[b] // n] + gb[a, cell[b] % n], ga[b, cell[a] // n] + gb[b, cell[a] % n]) <= less.reach
    assert len(a) > 500 and meet.mean() > target - 0.04


def test_memory_holds_no_rows_by_codes_by_dimensions():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((512, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = embedding_dedup.Grid(rng.standard_normal((198, 384)) * 0.05, rng.standard_normal((198, 384)) * 0.05, 0.1)
    tracemalloc.start()
    grid.locate(x)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_copies_of_a_vector_do_not_grow_with_the_table():
    """Tiles that isotropic vectors visit, and groups of visitors that a tile's own vectors meet: with tiles of 4,096 vectors they were 16 and 12 at 100,000, 100 and 59 at 600,000."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for rows in (100_000, 600_000):
        grid = embedding_dedup.fit_grid(x, rows, 0.95)
        home, row, _ = grid.visits(x[:256])
        tiles = len(grid.first) * -(-len(grid.second) // grid.cells)
        visits = len(row) / len(home)
        assert visits < 15 and visits * rows / tiles / embedding_dedup.block_rows(64) < 12
        assert np.bincount(grid.tile(grid.locate(x)[0])).max() * rows / len(x) < 2.5 * embedding_dedup.block_rows(64)
