"""Licence scans with a positional index of rare words.

Each template is a whole licence text, or a phrase, and has a mandatory key phrase. The index files every word of the key phrases with the
templates that hold it, and every template with its words by place. A document looks up its licence words: a template whose key words it does not all
hold is out; for the others the places of the word that is rarest in the corpus propose where the template would begin, and the next rarest words,
moved by their places in the template, leave only the beginnings on which all agree. What is left is the key phrase, word by word; around it the rest of the text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts as texts
from .bytescan import ALNUM, Texts, chunks


def license_words(text: str) -> list[str]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """text: the whole licence or notice; phrase: the part of it that must stand there word by word; base: a phrase whose places are counted."""

    label: str
    text: str
    phrase: str
    base: bool = False


# Well-known phrases and texts of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("agpl", "GNU Affero General Public License", "affero general public license"),
    Template("apache-2.0", texts.APACHE_2_NOTICE, "apache license version 2 0"),
    Template("bsd", texts.BSD_2 + texts.BSD_3_CLAUSE, "redistribution and use in source and binary forms"),
    Template("bsl-1.0", texts.BOOST, "to any person or organization obtaining a copy of the software"),
    Template("cc-by", texts.CC_DEED, "you must give appropriate credit provide a link to the license"),
    Template("cc-by-nc", "licensed under CC BY-NC", "cc by nc"),
    Template("cc-by-nd", "licensed under CC BY-ND", "cc by nd"),
    Template("cc-by-sa", "licensed under CC BY-SA", "cc by sa"),
    Template("cc0", texts.CC0_NOTICE, "cc0 1 0"),
    Template("gpl-3.0", texts.GPL_NOTICE, "free software foundation either version 3 of the license"),
    Template("gpl-3.0", "licensed under the GNU General Public License version 3", "gnu general public license version 3"),
    Template("isc", texts.ISC, "permission to use copy modify and or distribute this software"),
    Template("lgpl", "GNU Lesser General Public License", "lesser general public license"),
    Template("mit", texts.MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "released under the MIT License", "mit license"),
    Template("mpl-2.0", texts.MPL_2_NOTICE, "mozilla public license v 2 0"),
    Template("unlicense", texts.UNLICENSE, "this is free and unencumbered software"),
    Template("zlib", texts.ZLIB, "the origin of this software must not be misrepresented"),
)


#: Places times words of a template that are compared at once.
SCORED = 1 << 18


class PositionalIndex:
    """Postings of licence words. documents: how many documents there are; frequency: how many hold each word."""

    def __init__(self, templates: tuple[Template, ...], documents: int = 0, frequency: dict[str, int] | None = None):
        runs, phrases = [license_words(t.text) for t in templates], [license_words(t.phrase) for t in templates]
        self.vocabulary = sorted({w for run in runs for w in run})
        data = np.frombuffer(" ".join(self.vocabulary).encode(), dtype=np.uint8)
        hashes = Texts(data, np.array([0, len(data)]), ALNUM).hashes()
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        frequency = frequency or {}
        #: By word: how much its presence tells, from how few documents hold it.
        self.idf = np.array([math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in self.vocabulary])
        at = {w: k for k, w in enumerate(self.vocabulary)}
        #: By template: its words, where its key phrase begins, and the phrase's places by falling IDF of their words.
        self.runs = [np.array([at[w] for w in run]) for run in runs]
        self.begin = np.array([next(k for k in range(len(run)) if run[k : k + len(p)] == p) for run, p in zip(runs, phrases, strict=True)])
        self.order = [np.array(sorted(range(b, b + len(p)), key=lambda k, run=run: (-self.idf[run[k]], k))) for run, p, b in zip(self.runs, phrases, self.begin, strict=True)]
        #: By word: the templates whose key phrase holds it; by template: how many different words that phrase has, and its rarest word.
        keys = [np.unique(run[places]) for run, places in zip(self.runs, self.order, strict=True)]
        self.postings = [np.array([t for t, own in enumerate(keys) if w in own], dtype=np.int64) for w in range(len(self.vocabulary))]
        self.posted = np.array([len(p) for p in self.postings], dtype=np.int64)
        self.flat, self.offset = np.concatenate([*self.postings, np.zeros(0, dtype=np.int64)]), np.concatenate(([0], np.cumsum(self.posted)))
        self.needed = np.array([len(own) for own in keys])
        self.rarest = np.array([run[places[0]] for run, places in zip(self.runs, self.order, strict=True)])

    def words(self, found: Texts) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        hashes = found.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1).astype(np.int32)

    def candidates(self, own: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, template): the templates of which a text holds all key words; own, word: the known words of texts, as pairs."""
        pairs = np.unique(own * len(self.vocabulary) + word)
        own, word = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        counts = self.posted[word]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.offset[word], counts)
        met, times = np.unique(np.repeat(own, counts) * len(self.runs) + self.flat[at], return_counts=True)
        full = met[times == self.needed[met % len(self.runs)]]
        return full // len(self.runs), full % len(self.runs)

    def places(self, found: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, text, word where its key phrase begins, share of its weight that stands in place), for each template found, some places at once."""
        number = self.words(found)
        known = np.flatnonzero(number >= 0)
        own = np.searchsorted(found.first, known, side="right") - 1
        texts_met, templates_met = self.candidates(own, number[known])
        by_word = np.lexsort((known, own, number[known]))
        key = number[known][by_word] * np.int64(len(found.offsets)) + own[by_word]
        for t in np.unique(templates_met):
            run, order, mine = self.runs[t], self.order[t], texts_met[templates_met == t]
            # The rarest word's places in the candidate texts propose beginnings.
            wanted = run[order[0]] * np.int64(len(found.offsets)) + mine
            low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
            counts = high - low
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            text, start = np.repeat(mine, counts), known[by_word[at]] - order[0]
            begin, end = found.first[text], found.first[text + 1]
            inside = (start + order.min() >= begin) & (start + order.max() < end)
            text, start = text[inside], start[inside]
            for place in order[1:]:  # postings of the next rarest words, moved to the beginnings that they propose
                agree = number[start + place] == run[place]
                text, start = text[agree], start[agree]
            if not len(text):
                continue
            each = max(1, SCORED // len(run))
            for low in range(0, len(text), each):  # a text may hold a phrase any number of times
                mine, begins = text[low : low + each], start[low : low + each]
                at = begins[:, None] + np.arange(len(run))
                stands = (at >= found.first[mine][:, None]) & (at < found.first[mine + 1][:, None])
                stands[stands] = number[at[stands]] == np.broadcast_to(run, at.shape)[stands]
                share = (stands * self.idf[run]).sum(axis=1) / self.idf[run].sum()
                yield int(t), mine, begins + self.begin[t], np.minimum(share, 1.0)


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """All documents, and how many of them hold each licence word: as many rows reach the driver as the templates have words."""
    index = PositionalIndex(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary) + 1, dtype=np.int64)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(0)):
                found = Texts(data, offsets, ALNUM, lower=True)
                number = index.words(found)
                known = np.flatnonzero(number >= 0)
                pairs = np.unique((np.searchsorted(found.first, known, side="right") - 1) * len(index.vocabulary) + number[known])
                total[:-1] += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                total[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    return count.get(len(index.vocabulary), 0), {w: count.get(k, 0) for k, w in enumerate(index.vocabulary)}


def license_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, label, base, start, share): every place of every template's mandatory phrase; start is its first word, share how much of the template stands around it."""
    index = PositionalIndex(templates, *word_frequencies(docs, templates, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in chunks(batch.column(1)):
                found = Texts(data, offsets, ALNUM, lower=True)
                for k, own, start, share in index.places(found):
                    t, n = templates[k], len(own)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + i)), pa.array([t.label] * n, pa.string()), pa.array([t.base] * n, pa.bool_()), pa.array(start - found.first[own]), pa.array(share)], names=["id", "label", "base", "start", "share"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "id long, label string, base boolean, start long, share double").withColumnRenamed("id", id_col)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. n_base counts the places of base phrases; first_word and last_word are
    the smallest and the largest start of one (null without any); base_labels and labels are distinct, sorted and comma-joined, and
    labels holds both the base ones and those of the other templates whose key phrase stands in the text. score is the largest share of a template's
    weight (a word's IDF over all documents, and a little) that stands in its place around a key phrase, 0 without any. A null text counts as empty:
    no words, no labels. Texts of any length are scanned whole. Repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    """
    index = PositionalIndex(templates, *word_frequencies(docs, templates, text_col))
    labels = sorted({t.label for t in templates})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                found = Texts(data, offsets, ALNUM, lower=True)
                n = j - i
                count, score = np.zeros(n, dtype=np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                held, held_base = np.zeros((n, len(labels)), dtype=bool), np.zeros((n, len(labels)), dtype=bool)
                for k, own, start, share in index.places(found):
                    t, begin = templates[k], start - found.first[own]
                    held[own, labels.index(t.label)] = True
                    np.maximum.at(score, own, share)
                    if t.base:
                        held_base[own, labels.index(t.label)] = True
                        count += np.bincount(own, minlength=n)
                        np.minimum.at(first, own, begin)
                        np.maximum.at(last, own, begin)
                none = count == 0
                said = [[",".join(labels[k] for k in np.flatnonzero(row)) for row in h] for h in (held_base, held)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(found.counts()), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), *(pa.array(s, pa.string()) for s in said), pa.array(score)],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
