"""Vector operators and the quality model: brute force, recall and held-out accuracy, and corner cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventloom.llm import ann, embedding_dedup, licenses, quality, vectors
from eventloom.llm.components import connected_components
from eventloom.llm.runtime import table
from tests.conftest import DATA


def spoiled(spark, n=300, d=16, seed=0):
    """Vectors with planted near copies, equal rows and all that takes no part."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[100:140] = x[:40] + 0.05 * rng.standard_normal((40, d))
    x[140:160] = x[0]
    rows = [(k, v.tolist(), 1, 5, "clash") for k, v in enumerate(x)]
    odd = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], []]
    rows += [(n + k, v, 1, 5, "clash") for k, v in enumerate(odd)] + [(None, x[1].tolist(), 1, 5, "clash")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id long, h string").repartition(4)


def test_nearest_finds_neighbours(spark):
    x, rows = spoiled(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 10))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(f[1] != q for f in found)
        s = u @ u[q]
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        order = sorted((-round(float(s[k]), 12), k) for k in range(300) if k != q)[:5]
        hits += len({k for _, k in order} & {f[1] for f in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in sorted(got[0])] == [140, 141, 142, 143, 144]


@pytest.mark.parametrize("kind, most", [("isotropic", 0.75), ("clustered", 0.2)])
def test_routing_finds_nine_of_ten_and_leaves_out_the_rest(kind, most):
    """Recall of the 5 nearest against brute force, and the share of all rows that queries look at."""
    if kind == "isotropic":
        x = np.array([r["embedding"] for r in pq.read_table(f"{DATA}/sf0.1/embeddings.parquet").to_pylist()], dtype=float)
    else:
        rng = np.random.default_rng(2)
        x = rng.standard_normal((200, 64))[rng.integers(0, 200, 6000)] + 0.3 * rng.standard_normal((6000, 64))
    x = vectors.unit(x)
    router = ann.fit_router(x, 5)
    order = router.ranked(x)
    home, asked = order[:, 0], np.arange(0, len(x), 10)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    looked = order[asked, : router.probes]
    recall = (home[best][:, :, None] == looked[:, None, :]).any(axis=2).mean()
    scanned = np.bincount(home, minlength=len(router.bias))[looked].sum(axis=1).mean() / len(x)
    assert recall >= 0.9 and scanned < most, (recall, scanned)
    assert ann.fit_router(x, 5, target=1.0).probes == len(router.bias)


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0), few.limit(0), 5).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 12)) * 3
    x = vectors.unit(np.concatenate([c + rng.standard_normal((60, 12)) for c in centres]))
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(graph, 8, 1)
    assert np.ptp(np.bincount(part, minlength=8)) <= 3
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 0.5  # 0.125 for a random cut


def brute_links(x):
    ok = [k for k, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min(root[j] for j in np.flatnonzero(near[k])) for k in ok]
        if new == root:
            break
        root = new
    return near.sum(axis=1) - 1, root


@pytest.mark.parametrize("cell", [256, 8])
def test_embedding_dedup(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    x, rows = spoiled(spark)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(rows).collect()}
    links, root = brute_links(x)
    assert [got[k].n_links for k in range(300)] == links.tolist()
    assert [got[k].component_id for k in range(300)] == root
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(300, 307))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_vectors(rows.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 200: 0, 100: 100, 101: 100}


def test_quality_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), quality.grades_of(table(spark, sf, "labels"))
    model = quality.fit_quality(docs, labels.where("doc_id % 4 <> 0"))
    graded = quality.grade_documents(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").select("grade", "keep", "tail", "expected_grade").collect()
    share = {g: np.mean([r.keep for r in graded if r.grade == g]) for g in (0, 1, 2)}
    assert share[2] > 0.98 and share[0] < 0.05 and share[1] < 0.4
    assert all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 1 + r.tail + 1e-9 for r in graded)


def test_quality_corner_cases(spark):
    docs = spark.createDataFrame([(1, None, "clash"), (2, "", "clash"), (3, "word " * 20000, "clash"), (3, "word " * 20000, "clash"), (None, "x", "clash")], "doc_id long, text string, keep string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit_quality(docs, none)
    assert quality.grade_documents(docs, model).where("keep").count() == 5  # nothing known, nothing rejected
    assert quality.grade_documents(docs.limit(0), model).count() == 0
    some = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (None, 2), (9, None)], "doc_id long, grade int")
    assert quality.grade_documents(docs, quality.fit_quality(docs, some)).count() == 5


def test_sample_has_one_row_per_id(spark):
    rows = [(1, f"text number {k}") for k in range(500)] + [(2, "junk junk"), (3, "fine words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grades = spark.createDataFrame([(1, 2), (1, 0), (2, 0), (3, 2), (4, 1)], "doc_id long, grade int")
    seen = {}

    def fit(number, feature, value, graded, levels):
        seen["grades"] = sorted(graded.tolist())
        return quality.OrdinalModel(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(levels))

    original, quality.fit_ordinal = quality.fit_ordinal, fit
    try:
        quality.fit_quality(docs, grades, rows=4)
    finally:
        quality.fit_ordinal = original
    assert seen["grades"] == [0, 0, 1, 2]


def brute_features(text):
    """How many distinct words, and the share of each shape and of words that repeat the one before, among all words."""
    words = licenses.license_words(text or "")
    spaced = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kinds = [re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", re.sub(r"[^\x00-\x7F]", "a", w)))) for w in spaced]
    shapes = Counter(re.sub(r"(.)\1+", r"\1", k) for k in kinds)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    total = max(1, len(spaced))
    return len(set(words)), sorted([4 * (n / total) ** 0.5 for n in shapes.values()] + [4 * (again / total) ** 0.5] * (again > 0))


def test_features_against_plain_python():
    texts = ["The the THE cat, cat2 dog!!", "", "x", "Aa bB 12 3a caf\u00e9 \u00e9t\u00e9 -- --", "spam " * 40 + "End.", "a-b a b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    row, feature, value = quality.features(np.frombuffer(data, dtype=np.uint8), offsets)
    for k, text in enumerate(texts):
        words, shares = brute_features(text)
        mine = np.sort(value[row == k])
        assert len(set(feature[row == k])) == len(mine) == words + len(shares)
        assert np.allclose(mine, np.sort([1.0] * words + shares), atol=1e-5), text


def test_fit_is_the_best_dense_fit():
    """Without shrinkage the fit is a stationary point of the likelihood, written out densely."""
    rng = np.random.default_rng(4)
    n, d = 400, 5
    x = (rng.random((n, d)) < 0.4).astype(float)
    grades = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0.5, 0.0]) + rng.logistic(size=n), [0.0, 1.5])
    row, col = np.nonzero(x)
    model = quality.fit_ordinal(row, col.astype(np.uint64), np.ones(len(row), dtype=np.float32), grades, lasso=0.0, steps=3000, refit=0)

    def likelihood(w, t):
        tail = np.stack([np.ones(n), *(1 / (1 + np.exp(c - x @ w)) for c in t), np.zeros(n)], axis=1)
        return np.log(tail[np.arange(n), grades] - tail[np.arange(n), grades + 1]).mean()

    w = np.zeros(d)
    w[model.feature.astype(int)] = model.weight
    best = likelihood(w, model.thresholds)
    for k in range(d + 2):
        for step in (-0.05, 0.05):
            v, t = w.copy(), model.thresholds.copy()
            (v if k < d else t)[k if k < d else k - d] += step
            assert likelihood(v, t) < best + 1e-5
    assert np.allclose(model.tails(model.score(n, row, col.astype(np.uint64), np.ones(len(row)))), np.stack([1 / (1 + np.exp(c - x @ w)) for c in model.thresholds], axis=1))


def test_thresholds_are_ordered_and_score_follows_grade():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = np.repeat(np.arange(600), 2)
    feature = np.stack([grades, rng.integers(10, 12, 600)], axis=1).ravel().astype(np.uint64)
    model = quality.fit_ordinal(rows, feature, np.ones(1200, dtype=np.float32), grades)
    assert np.all(np.diff(model.thresholds) > 0)
    score = model.score(600, rows, feature, np.ones(1200))
    assert score[grades == 0].max() < score[grades == 1].min() < score[grades == 2].min()
