"""The prefix trie against building it node by node in Python, with small blocks so that intervals cross them, and corner cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from eventloom.llm import conversation_trie as t

SCHEMA = "conv_id long, turn long, role string, text string, depth int, r string, `end` string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        gain = (len(who) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += kids[node] == 0
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node)).encode()).hexdigest()
    return sorted((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), kids[n], leaves[n], saved[n], sha(n)) for n, who in members.items())


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(4)
    got = t.prefix_trie(t.rebuilt_turns(t.numbered_turns(frame))).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0], r[1]))


def talks(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.randrange(4 * convs)
        for k in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, None if rng.random() < 0.05 else k, rng.choice(["user", None, "bot"][:2]), rng.choice(["hi", "hi", "yes é", "", None, "\U0001f642 ok"])))
    return rows


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 2)
    monkeypatch.setattr(t, "LEAST_BLOCK", 2)
    monkeypatch.setattr(t, "PIECE", 3)
    rows = talks(1, 60, 7)
    rows += [(5000 + 100 * k, j, "u", "same") for k in range(9) for j in range(9)] + [(7000, j, "u", f"t{j}") for j in range(23)] + [(7100, j, "u", f"t{j}" if j < 21 else "x") for j in range(23)]
    rows += rows[:10]
    assert run(spark, rows) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("rows", [
    [(7, 0, "u", "a")],
    [(None, 0, "u", "a"), (3, None, None, None)],
    [(c, 0, "u", "a") for c in (101, 102, 103, 104, 105, 106)],  # all but those that keep their turn have none
    [(c, 0, "u", "a" * 20_000) for c in range(300, 900, 100)],
])
def test_corner_cases(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_empty_table(spark):
    assert t.prefix_trie(t.rebuilt_turns(t.numbered_turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_nearest_smaller_values_and_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 200):
        v = rng.integers(0, 6, n)
        before, after = t.smaller_values(v)
        least = t.Minima(v)
        for i in range(n):
            assert before[i] == max((k for k in range(i) if v[k] < v[i]), default=-1)
            assert after[i] == min((k for k in range(i + 1, n) if v[k] < v[i]), default=n)
            for x in (0, 3, 6):
                assert least.next_below(i, x) == min((k for k in range(i + 1, n) if v[k] < x), default=-1)
        low, high = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        assert least.least(low, high, 99).tolist() == [min(v[a:b].tolist(), default=99) for a, b in zip(low, high, strict=True)]
