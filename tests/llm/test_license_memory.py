"""Licence places in slices: the same places, labels and scores as at once, and little memory on a text full of one phrase."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from eventloom.llm import licenses as li
from eventloom.llm.bytescan import ALNUM, Texts, chunks

PHRASE = "redistribution and use in source and binary forms "


def places(texts):
    index, out = li.PositionalIndex(li.TEMPLATES, 10, {}), []
    for i, _, data, offsets in chunks(pa.array(texts)):
        for k, own, start, share in index.places(Texts(data, offsets, ALNUM, lower=True)):
            out += zip([k] * len(own), (own + i).tolist(), start.tolist(), share.tolist(), strict=True)
    return sorted(out)


def test_slices_find_the_same(monkeypatch):
    texts = [PHRASE * 40 + t.text + " cc by " + t.phrase for t in li.TEMPLATES] + ["", "none", PHRASE * 500]
    whole = places(texts)
    monkeypatch.setattr(li, "SCORED", 1000)
    assert places(texts) == whole and len(whole) > 1000


def test_memory_of_a_long_text():
    text, index = PHRASE * 100_000, li.PositionalIndex(li.TEMPLATES, 10, {})
    ((_, _, data, offsets),) = chunks(pa.array([text]))
    tracemalloc.start()
    n = sum(len(own) for _, own, _, _ in index.places(Texts(data, offsets, ALNUM, lower=True)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and most < 40 * len(text), most / len(text)
    assert np.isfinite(most)
