"""p-values against listing all signs, and against known tails."""

from __future__ import annotations

import itertools
import math
import random

from eventloom.operators import rank_tests as rt


def test_signed_ranks_against_all_signs():
    rng = random.Random(2)
    for n in range(1, 11):
        for _ in range(4):
            twice = [rng.randrange(1, 2 * n + 1) for _ in range(n)]
            w = rng.choice([sum(twice) / 4, rng.randrange(sum(twice) + 1) / 2])
            ways = sum(sum(t for t, s in zip(twice, signs, strict=True) if s) <= 2 * w for signs in itertools.product((0, 1), repeat=n))
            assert abs(rt.signed_rank_p(twice, w) - min(1.0, 2 * ways / 2**n)) < 1e-12
    many = list(range(2, 2 * 260 + 1, 2))
    assert abs(rt.signed_rank_p(many[:200], 8000) - rt.signed_rank_p(many[:200], 8000.4)) < 1e-9
    exact, rt.EXACT = rt.EXACT, 1000
    counted = rt.signed_rank_p(many, 14000)
    rt.EXACT = exact
    assert abs(rt.signed_rank_p(many, 14000) - counted) < 2e-3 * max(counted, 0.05) + 1e-3


def test_chi_square_tail():
    for df in range(1, 9):
        for x in (0.3, 2.0, 7.5, 20.0):
            a = df / 2
            lower = sum(math.exp((a + i) * math.log(x / 2) - x / 2 - math.lgamma(a + i + 1)) for i in range(400))
            assert abs(rt.chi_square_tail(x, df) - (1 - lower)) < 1e-10
    assert rt.chi_square_tail(0.0, 3) == 1.0


def test_equal_groups_and_leaders(spark):
    rows = [(b, g, v) for b in range(8) for g, v in (("x", b + 1.0), ("y", b + 1.0), ("z", float(b)))]
    scores = spark.createDataFrame(rows, "block int, model string, v double")
    got = {(r.a, r.b): r for r in rt.wilcoxon_test(scores, "block", "model", "v").collect()}
    assert got["x", "y"].p_value == 1.0 and not got["x", "y"].rejected and got["x", "y"].n == 0
    assert abs(got["x", "z"].p_value - 2 / 2**8) < 1e-12 and got["x", "z"].rejected and got["y", "z"].rejected
    board = {r.model: (r.mean_rank, r.wins, r.losses) for r in rt.leaderboard(scores, "block", "model", "v").collect()}
    assert board == {"x": (1.5, 1, 0), "y": (1.5, 1, 0), "z": (3.0, 0, 2)}
