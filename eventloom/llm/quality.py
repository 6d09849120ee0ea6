"""Document quality as an ordinal grade: cumulative-link regression over hashed text features.

Grades are ordered (here 0 junk, 1 readable but toxic, 2 clean). One weight per hashed feature is shared by all thresholds:
P(grade >= j) = sigmoid(score - threshold j), thresholds rising. The model gives an expected grade and the probability of each tail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import ALNUM, SPACED, Texts, chunks, mix, run_hash
from .runtime import cut

#: Labelled rows that a model is fitted on at most, taken by a seeded hash of their ids.
SAMPLE_ROWS = 12000
#: Rows of the sample that must have a feature before it gets a weight.
LEAST_ROWS = 4
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def _shapes(texts: Texts) -> np.ndarray:
    """A hash of each word's shape: its kinds of characters (lower and upper case, digits, each other sign), runs as one."""
    kind = _SHAPE[texts.data]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[texts.starts] = True
    at = np.concatenate(([0], np.cumsum(new)))
    return run_hash(mix(kind[new].astype(np.uint64)), at[texts.starts], at[texts.ends])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a chunk of texts, each feature once a text: words (letters and digits, A-Z lower-cased) by presence, shapes and repeats by their share."""
    words, spaced = Texts(data, offsets, ALNUM, lower=True), Texts(data, offsets, SPACED)
    own, hashes = words.owners(), words.hashes()
    again = np.flatnonzero((own[1:] == own[:-1]) & (hashes[1:] == hashes[:-1])) + 1
    shapes, rows = _shapes(spaced) ^ np.uint64(0x5A5A5A5A5A5A5A5A), spaced.owners()
    total = np.maximum(1, spaced.counts())
    parts = []
    for row, feature, shared in ((own, hashes, False), (rows, shapes, True), (own[again], np.full(len(again), 7, dtype=np.uint64), True)):
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])))) if len(row) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(first, len(row)))
        value = np.sqrt(count / total[row[first]]) if shared else np.ones(len(first))
        parts.append((row[first], feature[first], value.astype(np.float32) * (4 if shared else 1)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass(frozen=True)
class OrdinalModel:
    """feature: sorted hashes that have a weight; thresholds: rising, one fewer than grades."""

    feature: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def score(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.feature, feature), len(self.feature) - 1)
        return np.bincount(row, weights=np.where(self.feature[at] == feature, self.weight[at], 0.0) * value, minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(rows: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, levels: int = 2, lasso: float = 7e-4, steps: int = 300, refit: int = 150) -> OrdinalModel:
    """Fit by full-batch gradient steps with per-coordinate scaling (Adam), each followed by a shrinkage of the weights that drops idle ones; the last `refit` steps no longer shrink those that are left. Grades are 0 to levels. Without rows the model knows nothing: score 0, thresholds 0."""
    names, at, seen = np.unique(feature, return_inverse=True, return_counts=True)
    keep = seen >= LEAST_ROWS
    names, number = names[keep], np.cumsum(keep) - 1
    used = keep[at]
    rows, at, value, n = rows[used], number[at[used]], value[used].astype(np.float64), len(grades)
    if n == 0:
        return OrdinalModel(names, np.zeros(len(names)), np.zeros(levels))
    above = grades[:, None] >= np.arange(1, levels + 1)[None, :]
    share = np.clip(above.mean(axis=0), 0.01, 0.99)
    base = np.log((1 - share) / share)
    # Thresholds are the first one and the positive steps between them, so they stay in order.
    free = np.concatenate((np.zeros(len(names)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))))
    mean, square = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + refit + 1):
        weight, first, gaps = free[: len(names)], free[len(names)], np.exp(free[len(names) + 1 :])
        thresholds = first + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(rows, weights=weight[at] * value, minlength=n)
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))
        # Cumulative likelihood of the tails: each grade's probability is a difference of neighbouring tails.
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), axis=1)
        by_score = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / p
        by_low = np.zeros((n, levels + 2))
        by_low[np.arange(n), grades] -= slope[np.arange(n), grades] / p
        by_low[np.arange(n), grades + 1] += slope[np.arange(n), grades + 1] / p
        to_threshold = by_low[:, 1 : levels + 1].sum(axis=0) / n
        up = np.concatenate((np.bincount(at, weights=by_score[rows] * value, minlength=len(names)) / n, [to_threshold.sum()], np.cumsum(to_threshold[::-1])[::-1][1:] * gaps))
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
        rate = 0.05 / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        free = free + rate * mean / (1 - 0.9**step)
        weight = free[: len(names)]
        if step > steps:
            weight[idle] = 0
            continue
        free[: len(names)] = np.sign(weight) * np.maximum(np.abs(weight) - np.minimum(rate[: len(names)], 50) * lasso, 0)
        idle = free[: len(names)] == 0
    thresholds = free[len(names)] + np.concatenate(([0.0], np.cumsum(np.exp(free[len(names) + 1 :]))))
    live = np.flatnonzero(free[: len(names)])
    return OrdinalModel(names[live], free[live], thresholds)


def _feature_rows(docs: DataFrame, keep: list[str], names: np.ndarray | None) -> DataFrame:
    """keep + (feature, value): each text's features as lists; names: only those (sorted)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(len(keep))):
                row, feature, value = features(data, offsets)
                if names is not None:
                    at = np.minimum(np.searchsorted(names, feature), max(0, len(names) - 1))
                    used = names[at] == feature if len(names) else np.zeros(len(feature), dtype=bool)
                    row, feature, value = row[used], feature[used], value[used]
                order = np.argsort(row, kind="stable")
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature[order].view(np.int64), value[order])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), *lists], names=[*keep, "feature", "value"])

    return docs.select(*keep, "text").mapInArrow(scan, f"{schema}, feature array<long>, value array<float>")


def fit_quality(docs: DataFrame, grades: DataFrame, levels: int = 2, rows: int = SAMPLE_ROWS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """The model of a bounded sample: `rows` graded documents, by a seeded hash of their ids, or all if there are fewer.

    grades has id_col and `grade` (0 to levels); null ids and grades are left out, of several grades of an id the lowest counts, and of several
    texts of an id the first by code point (null: empty), so the sample has `rows` rows at most however often an id stands. Only features that
    LEAST_ROWS rows of the sample have reach the driver. Without graded documents the model gives every text the score 0 and thresholds of 0.
    """
    graded = grades.where(F.col(id_col).isNotNull() & F.col("grade").between(0, levels)).groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    sample = graded.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))  # at most `rows` ids
    texts = cut(texts.groupBy("_id").agg(F.min("grade").alias("grade"), F.min(F.coalesce("text", F.lit(""))).alias("text")))
    seen = _feature_rows(texts, ["_id"], None).select(F.explode("feature").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    names = np.sort(np.asarray(seen.where(F.col("n") >= LEAST_ROWS).select("feature").toArrow().column(0), dtype=np.int64).view(np.uint64))
    found = _feature_rows(texts, ["_id", "grade"], names).orderBy("_id").toArrow()
    lists = found.column("feature").combine_chunks()
    number = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    feature = np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
    value = np.asarray(found.column("value").combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return fit_ordinal(number, feature, value, np.asarray(found.column("grade").combine_chunks()), levels)


def grade_documents(docs: DataFrame, model: OrdinalModel, keep_from: int = 2, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with expected_grade (sum of the tails), tail (P(grade >= keep_from)) and keep (tail >= least); one row per row of docs.

    A null or empty text has no features and is judged by the thresholds alone. Repeated rows stay; an empty table gives no rows; a column that
    has the name of an added one gives way to it, others stay whatever their names. The whole text counts, whatever its length.
    """
    added = ["expected_grade", "tail", "keep"]
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    columns, text_at = docs.columns, docs.columns.index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(text_at)):
                tails = own.tails(own.score(j - i, *features(data, offsets)))
                tail = tails[:, keep_from - 1]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(columns))), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=[*columns, *added])

    return docs.mapInArrow(scan, f"{schema}, expected_grade double, tail double, keep boolean")


def grades_of(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> (doc_id, grade): 0 of no quality, 1 good but toxic, 2 good. A null quality gives no grade, a null toxic counts as 0."""
    grade = F.when(F.col("quality").isNull(), None).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.select("doc_id", grade.alias("grade"))
