"""Nearest neighbours through learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts with few edges between them; a small classifier learns which part a vector
belongs to. Every vector is indexed under its most probable part, every query looks into its several most probable ones and ranks what it
finds by exact cosine. How many parts a query looks into is measured on held-out vectors of the sample, for a target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut
from .vectors import cosine, matrix, sampled, unit, usable

#: Vectors that the partitions are fitted on at most; neighbours in the graph; the recall that held-out queries must reach.
SAMPLE, DEGREE, TARGET = 8192, 10, 0.93
#: Parts at most, and sampled vectors that a part must rest on: fine parts let a query leave out more of what is far.
PARTS, PER_PART = 256, 16
#: Vectors in a block of a part, and queries that meet a block at once.
BLOCK, QUERIES = 8192, 16384


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest rows of each row by cosine, itself left out."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), degree), dtype=np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree] if degree else out[i : i + 1024]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Cut a graph into `parts` (a power of two) parts whose sizes differ by one at most: halve it along its slowest direction, then swap nodes that have more edges across."""
    rng = np.random.default_rng(seed)
    n = len(graph)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = np.zeros(n, dtype=np.int64)
    for _ in range(int(math.log2(parts))):
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        x = rng.standard_normal(n)
        size = np.bincount(part)
        for _ in range(30):  # power steps on the lazy walk within each part, its constant taken out
            x = x - (np.bincount(part, weights=x * degree) / np.bincount(part, weights=degree))[part]
            x = x / np.sqrt(np.bincount(part, weights=x * x) / size + 1e-30)[part]
            x = (x + (np.bincount(a, weights=x[b], minlength=n) + np.bincount(b, weights=x[a], minlength=n)) / degree) / 2
        order = np.lexsort((x, part))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - np.concatenate(([0], np.cumsum(size)[:-1]))[part[order]]
        half = (2 * place >= size[part]).astype(np.int64)
        for _ in range(8):
            across = np.where(half[a] != half[b], 1.0, -1.0)
            gain = np.bincount(a, weights=across, minlength=n) + np.bincount(b, weights=across, minlength=n)
            moved = False
            for p in range(len(size)):
                own = np.flatnonzero(part == p)
                left, right = (own[half[own] == h] for h in (0, 1))
                left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
                k = min(len(left), len(right))
                swap = np.flatnonzero(gain[left[:k]] + gain[right[:k]] > 2)[: max(1, k // 10)]
                half[left[swap]], half[right[swap]] = 1, 0
                moved |= len(swap) > 0
            if not moved:
                break
        part = 2 * part + half
    return part


@dataclass(frozen=True)
class Router:
    """A softmax classifier of unit vectors; probes: parts that a query looks into; recall: measured with them on held-out vectors of the sample."""

    weight: np.ndarray
    bias: np.ndarray
    probes: int
    recall: float

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability, a row for each row of x."""
        return np.argsort(-(x @ self.weight + self.bias), axis=1, kind="stable")


def _classifier(x: np.ndarray, wanted: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft labels (full-batch Adam)."""
    w = np.zeros((x.shape[1] + 1, wanted.shape[1]))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    for step in range(1, steps + 1):
        z = x1 @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        up = x1.T @ (wanted - p / p.sum(axis=1, keepdims=True)) / len(x) - 1e-4 * w
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
        w = w + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], w[-1]


def fit_router(x: np.ndarray, k: int, target: float = TARGET, seed: int = 5) -> Router:
    """Fit on unit vectors x, a sample. A quarter is held out: the probes are the fewest with which its k nearest among itself are found at the target rate.

    In the whole table the k nearest are nearer than in the sample, so the rate there is rather higher. A target of 1 looks into all parts.
    """
    held = np.zeros(len(x), dtype=bool)
    held[3::4] = True
    own = x[~held]
    parts = 1 << int(math.log2(max(1, min(PARTS, len(own) // PER_PART))))
    if parts < 2 or held.sum() <= k:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1, 1.0)
    graph = neighbour_graph(own, DEGREE)
    part = balanced_parts(graph, parts, seed)
    soft = np.zeros((len(own), parts))
    np.add.at(soft, (np.repeat(np.arange(len(own)), graph.shape[1]), part[graph.ravel()]), 0.5 / graph.shape[1])
    soft[np.arange(len(own)), part] += 0.5
    weight, bias = _classifier(own, soft)
    router = Router(weight, bias, parts, 1.0)
    test = x[held]
    order = router.ranked(test)
    turn = np.empty_like(order)
    turn[np.arange(len(test))[:, None], order] = np.arange(parts)
    near = neighbour_graph(test, k)
    needed = np.take_along_axis(turn, order[near, 0], axis=1)
    recall = [(needed < p).mean() for p in range(1, parts + 1)]
    probes = parts if target >= 1 else next(p for p in range(1, parts + 1) if recall[p - 1] >= target)
    return Router(weight, bias, probes, float(recall[probes - 1]))


def _routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """rows (id, ids, vec) with `part`, once for each of the `probes` most probable parts."""
    shipped = rows.sparkSession.sparkContext.broadcast(router)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = shipped.value.ranked(unit(matrix(batch.column(2))))[:, :probes]
                ends = pa.array(np.arange(0, parts.size + 1, parts.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(parts.ravel(), pa.int32()))], names=["id", "ids", "vec", "parts"])

    return rows.select("id", "ids", "vec").mapInArrow(scan, "id long, ids array<long>, vec array<double>, parts array<int>").withColumn("part", F.explode("parts")).drop("parts")


def _best(query_ids: np.ndarray, queries: np.ndarray, lists: list[list[int]], vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, neighbour, score): each query's k best neighbours among the classes; a matrix product picks, exact cosines decide."""
    unit_vectors, most = unit(vectors), min(k + 1, len(vectors))
    for i in range(0, len(queries), 256):
        near = unit(queries[i : i + 256]) @ unit_vectors.T
        floor = np.partition(near, len(vectors) - most, axis=1)[:, len(vectors) - most] - 1e-9
        q, c = np.nonzero(near >= floor[:, None])
        score = cosine(queries[i : i + 256][q], vectors[c])
        order = np.lexsort((-score, q))
        ends = np.searchsorted(q, np.arange(len(near) + 1))
        for j in range(len(near)):
            own = int(query_ids[i + j])
            found = sorted((-float(score[o]), v) for o in order[ends[j] : ends[j + 1]] for v in lists[c[o]] if v != own)
            for s, v in found[:k]:
                yield own, v, -s


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 5) -> DataFrame:
    """(query_id, rank, id_col, score): the k rows found nearest to each row of queries by cosine in double precision, ties to the smaller id.

    A row is no neighbour of its own id; fewer candidates give fewer ranks. Vectors that are null, zero, hold null or non-finite
    components, have a null id or another length than most, take no part, as rows or as queries. Equal vectors are one class of the index, which keeps
    the k + 1 smallest ids: no more of them can be among the nearest. A repeated id counts once. Other columns are not read, whatever their names.
    An empty table gives no rows.
    """
    good = usable(rows, id_col, vec_col).where("ok").select("id", "vec")
    salts = max(1, good.count() // 10_000)
    lowest = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, k + 1)
    some = good.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(lowest(F.collect_set("id")).alias("ids"))
    classes = cut(some.groupBy("vec").agg(lowest(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "vec"))
    total = classes.count()
    if total == 0:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    router = fit_router(sampled(classes, "vec", SAMPLE, seed), k, target, seed)
    indexed = cut(_routed(classes, router, 1))
    asked = usable(queries, id_col, vec_col).where("ok").dropDuplicates(["id"]).select("id", F.array("id").alias("ids"), "vec").where(F.size("vec") == len(router.weight))
    asked = cut(_routed(asked, router, router.probes))
    blocks = indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    groups = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("groups"))
    sizes = F.broadcast(blocks.join(groups, "part"))  # one row per part, PARTS at most
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "part").select("part", every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("groups")).alias("group"), "id", "vec")
    right = indexed.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), every("groups").alias("group"), "ids", "vec")

    def search(query: pa.Table, block: pa.Table) -> pa.Table:
        found = list(_best(np.asarray(query["id"]), matrix(query["vec"]), block["ids"].to_pylist(), matrix(block["vec"]), k)) if len(query) and len(block) else []
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    key = ["part", "block", "group"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
