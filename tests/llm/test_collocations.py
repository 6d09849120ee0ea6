"""Collocations against counting every phrase in Python, with few and many buckets, and their corner cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import numpy as np
import pytest

from eventloom.llm import collocations as c


def brute(rows, least, top, cover):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= cover * a for q, b in cand.items())
            if not inside:
                rows_.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (s, _, p, a, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, docs):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "É", "ü-b", "a_b", "x" * 40, "\x1c", "\x00q", "漢字", "Ⅸ"] + [f"w{k}" for k in range(30)]
    out = [(None, "en"), ("", None), (" \t ", "de"), ("new york city hall " * 60, "en"), ("one", None), ("a. b, c;d", "en")]
    for _ in range(docs):
        n = rng.choice([1, 5, 40, 200])
        out.append(("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(n)), rng.choice(["en", "en", "en", "de", None, "und"])))
    return out + out[:20]


@pytest.mark.parametrize("seed, least, buckets", [(1, 3, 8192), (2, 2, 1 << 20), (3, 300, 1 << 16), (4, 1, 1 << 24)])
def test_equals_counting_everything(spark, seed, least, buckets):
    rows = texts(seed, 120)
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, a long, phrase string").repartition(5)
    got = sorted(map(tuple, c.collocations(frame, least=least, top=50, cover=80, buckets=buckets).collect()))
    assert got == brute(rows, least, 50, 80)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rows = texts(9, 60)
    long = " ".join(t for t, _ in rows if t)
    for size in (7, 64, 1000):
        monkeypatch.setattr(c, "SLICE", size)
        column = pa.array([long, None, "", long[:501], "z" * 5000], pa.string()).fill_null("")
        counts = {k: Counter() for k in (1, 2, 4)}
        for words in c._slices(column, np.zeros(5, np.int64)):
            names = words.names.to_pylist()
            for k in counts:
                for e in words.ends(k):
                    counts[k][b" ".join(names[words.code[e - k + 1 + j]] for j in range(k)).decode()] += 1
        for k, found in counts.items():
            want = Counter()
            for t in (long, long[:501], "z" * 5000):
                for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                    w = re.findall("[^ \t]+", piece)
                    want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
            assert found == want


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**18
    rows = [("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 7)]
    got = c.scored_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, a long")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(big + 1, big, 2000000 * (big - 7) // (2 * big + 1))]


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
