"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank (the place of a fingerprint in the reflected Gray code, whose neighbours differ in one bit).
A node of the index is a run of that order and keeps the bits that all its members share. Two nodes are compared before their members:
when the shared bits alone differ in more than the allowed places, the whole pair of groups is dropped. Nodes are cut at prefixes of the
rank, so the upper levels are plain aggregates (bit_and, bit_or) and the descent is a few equi-joins from the pair (root, root).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .bytescan import chunks, shingles
from .components import connected_components
from .runtime import cut
from .skew import join_salted

#: Fingerprints in a block of the lowest level that Spark sees, and in a leaf within a block.
BLOCK, LEAF = 16384, 16


def _majority(text: bytes, shingle: int) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for pieces in shingles(text, shingle):
        bits = np.unpackbits(np.frombuffer(b"".join(map(xxh64_digest, pieces, repeat(42))), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones, n = ones + bits.sum(axis=0, dtype=np.int64), n + len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): each whole text's SimHash, as a signed long.

    Words are runs of non-space characters of the text with A-Z lower-cased; a text with fewer words than a shingle is one shingle, one
    without words (null, empty, blank) has fingerprint 0. Texts of any length are hashed whole, some shingles at a time. Rows stay as they are,
    repeats and null ids included; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_majority(data[a:b].tobytes(), shingle) for _, _, data, offsets in chunks(batch.column(1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def gray_rank(fp: str) -> F.Column:
    """The rank of a fingerprint in the reflected Gray code: the running XOR of its bits from the top."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def _prefix(rank: F.Column, bits: int) -> F.Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(rank, 63 - bits), 1)


def _levels(blocks: int) -> list[int]:
    """Bits of the rank that the nodes of each level share, from the root down; about as many nodes below as blocks are wanted."""
    deepest = max(0, math.ceil(math.log2(max(1, blocks))))
    return sorted({0, deepest, *range(deepest, 0, -3)})


def _shared(nodes: DataFrame, key: str, ones: str, zeros: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.bit_and(ones).alias("ones"), F.bit_or(zeros).alias("any"))


def _apart(a: str, b: str) -> F.Column:
    """Differences that all members of two nodes have: bits that are set in all of one and in none of the other."""
    return F.bit_count(F.expr(f"({a}.ones & ~{b}.any) | ({b}.ones & ~{a}.any)"))


def spanning_links(pairs: np.ndarray, up: dict[int, int]) -> list[tuple[int, int]]:
    """Those of the pairs that join trees of the forest `up`, which takes them in: the same components by fewer links."""

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = y = up.get(y, y)
            x = y
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _leaf_nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(x), LEAF)
    return np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at)


def _close(x: np.ndarray, y: np.ndarray, most: int, same: bool) -> Iterator[np.ndarray]:
    """Index pairs of x and y at most that many bits apart, found through the leaves of either; same: y is x, and each pair comes once."""
    (xa, xo), (ya, yo) = _leaf_nodes(x), _leaf_nodes(y)
    step = np.arange(LEAF)
    for i in range(0, len(xa), 64):
        a, o = xa[i : i + 64, None], xo[i : i + 64, None]
        p, q = np.nonzero(np.bitwise_count((a & ~yo) | (ya & ~o)) <= most)
        p = p + i
        if same:
            p, q = p[p <= q], q[p <= q]
        for j in range(0, len(p), 4096):
            m = np.minimum(p[j : j + 4096, None] * LEAF + step, len(x) - 1)
            n = np.minimum(q[j : j + 4096, None] * LEAF + step, len(y) - 1)
            hit, u, v = np.nonzero(np.bitwise_count(x[m][:, :, None] ^ y[n][:, None, :]) <= most)
            pairs = np.stack([m[hit, u], n[hit, v]], axis=1)
            yield pairs[pairs[:, 0] < pairs[:, 1]] if same else pairs


def near_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """(a long, b long): links among distinct fingerprints `fp`, at most `most` bits apart, thinned to a spanning forest within each pair of blocks.

    No link between components is lost: for every two fingerprints within the distance, the result connects them.
    """
    ranked = distinct.select("fp", gray_rank("fp").alias("rank"))
    levels = _levels(distinct.count() // BLOCK)
    deepest = levels[-1]
    ranked = ranked.withColumn("node", _prefix(F.col("rank"), deepest))
    size = ranked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any"))
    nodes = {deepest: cut(size)}
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        nodes[lower] = nodes[lower].withColumn("parent", F.shiftrightunsigned("node", lower - upper))
        nodes[upper] = _shared(nodes[lower], "parent", "ones", "any").withColumnRenamed("parent", "node")
    pairs = nodes[0].select(F.col("node").alias("x"), F.col("node").alias("y"))
    for level in levels[1:]:
        a, b = nodes[level].alias("a"), nodes[level].alias("b")
        pairs = pairs.join(a, F.col("x") == F.col("a.parent")).join(b, F.col("y") == F.col("b.parent"))
        pairs = pairs.where((F.col("a.node") <= F.col("b.node")) & (_apart("a", "b") <= most)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    # A node with more members than a block (families of near copies share long prefixes) is several blocks.
    part = ranked.join(nodes[deepest].select("node", F.ceil(F.col("n") / BLOCK).alias("parts")), "node").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    blocks = cut(part.groupBy("node", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "fp")))["fp"].alias("fps")))
    a, b = blocks.select(F.col("node").alias("x"), F.col("part").alias("xp"), F.col("fps").alias("xs")), blocks.select(F.col("node").alias("y"), F.col("part").alias("yp"), F.col("fps").alias("ys"))
    pairs = pairs.join(a, "x").join(b, "y").where("x < y or xp <= yp")
    pairs = pairs.select((F.col("x").eqNullSafe(F.col("y")) & (F.col("xp") == F.col("yp"))).alias("same"), "xs", "ys").repartition(max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = (np.asarray(v.values.to_numpy(zero_copy_only=False)).view(np.uint64) for v in (xs, ys))
                up: dict[int, int] = {}
                for found in _close(x, y, most, same):
                    if links := spanning_links(np.stack([x[found[:, 0]].view(np.int64), y[found[:, 1]].view(np.int64)], axis=1), up):
                        kept = np.array(links, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp long, component_id (the smallest id among documents that it reaches by links, itself included).

    Equal fingerprints link, those of texts without words (fingerprint 0) too. Repeated rows stay. A null id takes no part in the smallest
    id, so a component of null ids only has a null component_id. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id")).withColumn("at", F.monotonically_increasing_id())
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = connected_components(near_links(distinct, most)).withColumnRenamed("node", "fp")
    classes = cut(distinct.join(roots, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    found = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    classes = cut(join_salted(classes, found, "root", "prints", "fp").select("fp", "component_id", "rows"))
    return join_salted(marked, classes, "fp", "rows", "at").select(F.col("id").alias(id_col), "fp", "component_id")
