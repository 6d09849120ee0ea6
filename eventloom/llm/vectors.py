"""Embedding rows as the vector operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>, ok boolean): ok where the vector has a direction: no null, no null or non-finite component, not all zero, and the table's most frequent length.

    Rows stay as they are; a null id is never ok.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    picked = picked.withColumn("ok", F.coalesce(F.col("id").isNotNull() & good, F.lit(False)))
    length = picked.where("ok").groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return picked.withColumn("ok", F.col("ok") & (F.size("vec") == (length["n"] if length else 0)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is divided out first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of matching rows, each by the same sums in the same order: equal vectors get equal values."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def sampled(classes: DataFrame, vec_col: str, most: int, seed: int) -> np.ndarray:
    """Unit vectors of at most `most` rows, by a seeded hash of the vectors: for fitting, on the driver."""
    taken = classes.select(F.col(vec_col).alias("vec"), F.xxhash64(F.lit(seed), vec_col).alias("h")).orderBy("h").limit(most).select("vec").toArrow()
    return unit(matrix(taken.column("vec")))
