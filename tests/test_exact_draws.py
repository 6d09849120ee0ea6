"""Draws and choices that may lose nothing, also on dense graphs, against brute force."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.functions.rand import u01
from eventloom.operators import graph, metrics, parsing, prepare, sampling, walks
from eventloom.operators.pairs import event_pairs
from eventloom.operators.removable import removable_edges

DAY = datetime(2026, 3, 1)


def test_every_prompt_with_a_non_neighbour_gets_one(spark):
    n = 60
    pairs = [(0, v) for v in range(1, 59)] + [(1, v) for v in range(60) if v not in (1, 7, 30)] + [(2, v) for v in range(60)] + [(3, 4)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    prompts = spark.createDataFrame([(k, k % 4) for k in range(400)], "id long, node long")
    got = {r.id: r.rejected for r in sampling.non_neighbours(prompts, ["id"], edges, n, lambda k: u01(3, "id", k)).collect()}
    assert set(got) == {k for k in range(400) if k % 4 != 2}
    barred = defaultdict(set)
    for u, v in pairs:
        barred[u].add(v)
    assert all(0 <= v < n and v != k % 4 and v not in barred[k % 4] for k, v in got.items())
    assert {v for k, v in got.items() if k % 4 == 0} == {59}
    assert min(Counter(v for k, v in got.items() if k % 4 == 1).values()) > 25  # 7 and 30, both likely


def test_non_edges_are_as_many_as_asked(spark):
    nodes = spark.range(12).withColumnRenamed("id", "seq_id")
    edges = spark.createDataFrame([(u, v) for u in range(12) for v in range(12) if u < v and (u + v) % 5], "u long, v long")
    free = {(u, v) for u in range(12) for v in range(12) if u != v and (u + v) % 5 == 0}
    assert sampling.non_edges(nodes, edges, 10, 1).count() == 10
    assert {(r.u, r.v) for r in sampling.non_edges(nodes, edges, 500, 1).collect()} == free


def brute_removable(n, edges, k):
    """Edge by edge, counting the components each time."""

    def parts(left):
        root = list(range(n))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in left:
            root[top(u)] = top(v)
        return len({top(x) for x in range(n)})

    left = [(u, v) for u, v, _ in edges]
    whole, gone, sources = parts(left), [], set()
    for u, v, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if v in sources or len(gone) >= k:
            continue
        rest = [e for e in left if e != (u, v)]
        if parts(rest) == whole:
            left = rest
            gone.append((u, v))
            sources.add(u)
    return gone


def test_removable_edges_edge_by_edge(spark):
    five = [(0, 1, 0.9), (2, 0, 0.8), (2, 3, 0.7), (0, 3, 0.3), (1, 2, 0.2)]
    rng, edges, n = random.Random(6), list(five), 4
    for _ in range(12):  # many graphs side by side: what is removed in one blocks nothing in another
        size = rng.choice([4, 6, 8])
        pairs = [(u, v) for u in range(size) for v in range(size) if u != v and (v, u) > (u, v) or u != v and rng.random() < 0.2]
        edges += [(n + u, n + v, rng.randint(1, 8) / 8) for u, v in rng.sample(pairs, min(len(pairs), 2 * size))]
        n += size
    edges = list({(u, v): (u, v, w) for u, v, w in edges}.values())
    frame = spark.createDataFrame(edges, "u long, v long, weight double")
    for k in (7, 10**6):
        found = removable_edges(spark.range(n).withColumnRenamed("id", "seq_id"), frame, k)
        assert sorted((r.u, r.v) for r in found.collect()) == sorted(brute_removable(n, edges, k))



def test_supports_are_drawn_for_each_anchor(spark):
    nodes = spark.createDataFrame([(k, DAY + timedelta(hours=k // 3)) for k in range(90)], "seq_id long, when timestamp")
    edges = spark.createDataFrame([(u, v) for u in range(60) for v in range(u + 1, 60, 7)], "u long, v long")
    got = defaultdict(list)
    for r in walks.support_anchors(nodes, edges, 4).orderBy("anchor", "place").collect():
        got[r.anchor].append((r.place, r.support))
    for a in range(90):
        among = 3 * (a // 3) + 3
        assert [p for p, _ in got[a]] == list(range(1 + min(4, among))) and got[a][0][1] == a
        drawn = [s for _, s in got[a][1:]]
        assert len(set(drawn)) == len(drawn) and all(s // 3 <= a // 3 for s in drawn)
    late = [frozenset(s for _, s in got[a][1:]) for a in range(60, 90)]
    assert len(set(late)) > 25 and all(s < 60 for found in late for s in found)  # nodes without edges come last
    none = walks.support_anchors(nodes.where("seq_id < 9"), edges.limit(0), 2)
    assert none.where("anchor = support and place = 0").count() == 9 and none.count() == 27


def test_pairs_of_many_stretches_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)], DAY + timedelta(hours=rng.randint(0, 900)), rng.uniform(-80, 80), None if k == 5 else rng.uniform(-170, 170)) for k in range(120)]
    nodes = spark.createDataFrame(rows + [(500, [1.0, 2.0, 3.0], None, 0.0, 0.0), (501, None, DAY, 0.0, 0.0)], "seq_id long, what_vec array<double>, when timestamp, lat double, lon double")
    for most in (None, 3):
        got = {(r.u, r.v): r for r in event_pairs(nodes, most).collect()}
        wanted = set()
        for a in rows:
            for b in rows:
                if (a[2], -a[0]) < (b[2], -b[0]) and (most is None or (b[2].date() - a[2].date()).days <= most):
                    wanted.add((a[0], b[0]))
        assert {p for p in got if 501 not in p} == wanted and not any(500 in p for p in got)
        assert all(abs(got[p].what_sim - sum(x * y for x, y in zip(rows[p[0]][1], rows[p[1]][1], strict=True))) < 1e-9 for p in wanted)
        assert all((got[p].km is None) == (5 in p) for p in wanted) and all(r.what_sim is None for p, r in got.items() if 501 in p)


def test_json_strings_and_events(spark):
    values = ["plain", 'q " \\ /', "a\tb\n\r\b\f", "é ü 漢字", "\U0001f642 ok", "\x01\x1f\x7f", "", None]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, s string")
    assert [r[0] for r in rows.orderBy("k").select(text.json_string(F.col("s"))).collect()] == [json.dumps(v) for v in values]
    answers = ['```json\n{"what": "x", "n": 1, "why": null}\n```', "no object", "{broken", None, 'text {"a": {"b": 2}} more']
    found = spark.createDataFrame(list(enumerate(answers)), "k int, s string").orderBy("k").select(parsing.json_event("s").alias("f")).collect()
    assert [r.f for r in found[1:4]] == [None] * 3
    assert found[0].f["what"] == "x" and found[0].f["n"] == "1" and found[0].f["why"] is None and found[4].f["a"] == '{"b":2}'


def test_feed_dates(spark):
    texts = ["Tue, 02 Jan 2024 08:00:00 GMT", "Tue, 2 Jan 2024 08:00:00 +0200", "02 Jan 2024 08:00:00 UTC", "2024-01-02T08:00:00", "soon", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, s string").orderBy("k").select(prepare.published_at("s", F.lit("2000-01-01").cast("timestamp")).cast("string").alias("t")).collect()
    assert [r.t for r in got] == ["2024-01-02 08:00:00", "2024-01-02 06:00:00", "2024-01-02 08:00:00", "2024-01-02 08:00:00", "2000-01-01 00:00:00", "2000-01-01 00:00:00"]


def test_undirected_measures(spark):
    nodes = spark.range(5).withColumnRenamed("id", "seq_id")
    path = spark.createDataFrame([(0, 1), (2, 1), (2, 3), (4, 3), (1, 0)], "u long, v long")
    assert graph.diameter(nodes, path).first().diameter == 4 and abs(graph.undirected_density(nodes, path).first().density - 0.4) < 1e-12
    assert graph.diameter(nodes, path.limit(1)).first().diameter is None
    ego = graph.induced(graph.ego(nodes, path, 1), path)
    assert {(r.source, r.u, r.v) for r in ego.where("source = 2").collect()} == {(2, 2, 1), (2, 2, 3)}


def test_friedman_of_one_group_is_null(spark):
    one = spark.createDataFrame([(k, "a", float(k)) for k in range(4)], "block int, model string, score double")
    assert metrics.friedman(one, "block", "model", "score").first().statistic is None
