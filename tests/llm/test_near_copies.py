"""The pipeline's near-copy stage against all pairs' five-word Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from eventloom.llm import jaccard
from tests.conftest import DATA


def shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def brute_kept(rows):
    """Places of the rows that stay, for rows of (id, text); ids are ranked with null last."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        place = (d is None, d or 0, i)
        best[top(i)] = min(place, best.get(top(i), place))
    return {p[2] for p in best.values()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_five_word_group(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = brute_kept(rows)
    found = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted(rows[k][0] for k in kept)


def test_null_and_repeated_ids(spark, tmp_path):
    clean, copy = " ".join(f"c{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60))
    near = copy + " more"
    rows = [(1, copy), (2, near), (2, clean), (None, copy), (None, near), (1, copy), (None, "only null"), (None, "ONLY null"), (7, ""), (8, None), (9, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    assert sorted(found, key=str) == sorted([(1, copy), (2, clean), (None, "only null"), (7, "")], key=str)


def test_families_whose_members_are_not_all_near(spark, tmp_path):
    """Copies with few to many edits, some of them the same in several copies, chains of edits, and texts that only share a passage."""
    draw = random.Random(5)
    base, passage = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(draw.randint(1, 9)):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], [f"x{k}"], ["same"], [words[at], "same"]])
        texts.append(words)
    chain = [f"c{k}" for k in range(120)]
    for k in range(25):
        chain = [*chain[4:], *(f"c{k}_{j}" for j in range(4))]
        texts.append(chain)
    texts += [passage + [f"o{k}_{j}" for j in range(draw.randint(5, 90))] for k in range(60)]
    draw.shuffle(texts)
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    kept = brute_kept(rows)
    assert 30 < len(kept) < 200
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    found = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert {r.doc_id for r in found.collect()} == kept


def test_simhash_alone_finds_close_copies(spark, tmp_path, monkeypatch):
    """With MinHash bands that no two texts share, copies at most 4 bits apart still go, by the exact check; close fingerprints of texts that are no copies do not link them."""
    monkeypatch.setattr(jaccard, "_bands", lambda hashes, factors, shifts: (hashes.sum() + np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    words = [f"w{k}" for k in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(["less", *words])), (4, " ".join(words[::-1])), (5, ""), (6, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pairs = {(r.a, r.b) for r in jaccard.simhash_pairs(docs.select("doc_id", "text").withColumnRenamed("doc_id", "rid")).collect()}
    assert pairs <= {(1, 2), (1, 3), (2, 3)} and len(pairs) >= 2
    found = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in found) == [1, 4, 5, 6]
