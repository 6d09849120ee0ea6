"""Near copies by exact Jaccard similarity of word shingles, found by SimHash and, where that cannot see them, by MinHash.

Texts of the same words are one class. Classes whose SimHash fingerprints are at most BITS bits apart, found through operator 9's Gray-order index, are candidates first.
Pairs at the least similarity have fingerprints some 10 bits apart, so classes that these links do not join are candidates too if their MinHash signatures
agree in a whole band. Every link of either is verified on the two full sets of shingles. In each bucket all members first meet its smallest member; only members that are then still in different
components meet each other, so a large family of near copies costs a link a member and bucket, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128, xxh64_intdigest

from .bytescan import chunks, shingles
from .components import connected_components
from .runtime import cut, drop
from .simhash import fingerprints, near_links
from .skew import fresh, join_salted

#: Differing bits of two SimHash fingerprints at most.
BITS = 4

#: Bands, and MinHashes in each: of pairs at Jaccard 0.8 a share of (1 - 0.8 ** 6) ** 64 = 4e-9 agrees in no band.
BANDS, DEEP = 64, 6

#: Parts of the hash space in which a set's hashes are counted: two sets share at most the smaller count of each part.
PARTS = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `width` words; fewer words are one run, no words have none."""
    found = [np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), dtype=np.uint64, count=len(pieces)) for pieces in shingles(text, width)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def words_digest(text: bytes) -> bytes:
    """A 128-bit hash of a text's words, A-Z lower-cased."""
    whole = xxh3_128()
    for words in shingles(text, 1):
        whole.update(b" ".join(words) + b" ")
    return whole.digest()


def _bands(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """A key for each band of the set's signature."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[i : i + 256, None] * factors + shifts).min(axis=0))
    least = least.reshape(BANDS, DEEP)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(DEEP):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets (rid, hashes) have a Jaccard similarity of that many per cent or more."""
    a, b = (sets.select(F.col("rid").alias(c), F.col("hashes").alias(f"{c}s")) for c in "ab")
    # |x & y| / |x | y| >= p / 100, with |x | y| = |x| + |y| - |x & y|; the common hashes stand in it once, so that they are looked for once.
    near = (100 + percent) * F.size(F.array_intersect("as", "bs")).cast("long") >= percent * (F.size("as").cast("long") + F.size("bs"))
    return cut(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"))


def simhash_pairs(classes: DataFrame, shingle: int = 5) -> DataFrame:
    """(a, b), a < b: pairs of classes (rid, text) that join all whose fingerprints a chain of steps of at most BITS differing bits links: of equal ones each with the smallest rid, of others these."""
    prints = cut(fingerprints(classes, shingle, "rid"))
    firsts = cut(prints.groupBy("fp").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")))
    equal = join_salted(prints, firsts, "fp", "n", "rid").select(F.col("first").alias("a"), F.col("rid").alias("b")).where("a < b")
    x, y = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    near = near_links(firsts.select("fp"), BITS).join(x, "a").join(y, "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    return cut(equal.union(near).distinct())


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """(rid, size, own, parts) of the sets (rid, hashes, parts) that can be near another one: own counts the hashes that no other of the sets has.

    No other set holds the own hashes, so what two sets share is at most size - own, of a union of at least size. parts comes back without them.
    """
    alone = sets.select("rid", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")).where("n = 1")
    own = alone.groupBy("rid", F.col("hash").bitwiseAND(PARTS - 1).cast("int").alias("part")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = own.groupBy("rid").agg(F.sum("n").alias("own"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("owns"))
    counted = sets.select("rid", F.size("hashes").cast("long").alias("size"), "parts").join(own, "rid", "left")
    others = F.transform("parts", lambda n, k: n - F.coalesce(F.element_at("owns", k), F.lit(0))).alias("parts")
    return counted.select("rid", "size", F.coalesce("own", F.lit(0)).alias("own"), others).where(f"100 * (size - own) >= {percent} * size")


def near_copy_groups(rows: DataFrame, shingle: int = 5, percent: int = 80, seed: int = 7) -> DataFrame:
    """rows (rid long, unique; text string) -> (rid, root): the rows that a chain of links joins share a root. Links are the pairs at Jaccard `percent` / 100 or above.

    Words are runs of non-space characters with A-Z lower-cased; a text with fewer words than a shingle is one shingle. Texts without words
    (null, empty, blank) are one group. An empty table gives no rows.
    """
    rng = np.random.default_rng(seed)
    factors, shifts = (rng.integers(0, 2**64, BANDS * DEEP, dtype=np.uint64) for _ in range(2))
    factors |= np.uint64(1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                same = [words_digest(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(same, pa.binary())], names=["rid", "same"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                sets = [shingle_hashes(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                full = np.array([k for k, x in enumerate(sets) if len(x)], dtype=np.int64)
                if not len(full):
                    continue
                keys = np.concatenate([_bands(sets[k], factors, shifts) for k in full])
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).slice(i, j - i).take(pa.array(np.repeat(full, BANDS)))], names=["band", "rid"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                found = [shingle_hashes(data[a:b].tobytes(), shingle).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
                counts = np.concatenate([np.bincount(x & (PARTS - 1), minlength=PARTS) for x in found]).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * PARTS, pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found))), parts], names=["rid", "hashes", "parts"])

    same = cut(rows.select("rid", "text").mapInArrow(words, "rid long, same binary"))
    firsts = cut(same.groupBy("same").agg(F.min("rid").alias("class"), F.count(F.lit(1)).alias("times")))
    classed = cut(join_salted(same, firsts, "same", "times", "rid").select("rid", "class"))
    drop(same, firsts)
    classes = rows.join(classed.where("rid = class").select("rid"), "rid").select("rid", "text")
    alike = simhash_pairs(classes, shingle)
    signed = cut(classes.mapInArrow(sign, "band long, rid long"))
    # Only bands of two classes or more are kept, and of their classes only those that can be near another; the smallest one left in a band is its pivot.
    shared = cut(signed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(join_salted(signed, shared, "band", "n", "rid").select("band", "rid"))
    drop(signed, shared)
    asked = members.select("rid").union(alike.select("a")).union(alike.select("b")).distinct()
    sets = cut(classes.join(asked, "rid").select("rid", "text").mapInArrow(hashed, "rid long, hashes array<long>, parts array<int>"))
    near = _linked(alike, sets, percent)
    joined = cut(connected_components(near).withColumnRenamed("node", "rid"))
    able = cut(_able(sets, percent))
    members = cut(members.join(able, "rid").select("band", "rid", "size", "own"))
    shared = cut(members.groupBy("band").agg(F.min(F.struct("rid", "size", "own")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(join_salted(members, shared, "band", "n", "rid").select("band", "rid", "size", "own", "pivot"))

    def fits(x: str, y: str):
        """Whether the sets may be that near: what x shares is at most its size - own, and the union holds y and x's own besides; and the other way round."""
        return F.expr(" and ".join(f"100 * ({a}.size - {a}.own) >= {percent} * ({b}.size + {a}.own)" for a, b in ((x, y), (y, x))))

    stars = members.withColumn("at", F.struct("rid", "size", "own")).where(F.col("rid") > F.col("pivot.rid")).where(fits("at", "pivot"))
    stars = stars.select(F.col("pivot.rid").alias("a"), F.col("rid").alias("b")).distinct()
    for c in "ab":  # classes that SimHash has joined need not meet
        stars = stars.join(joined.select(F.col("rid").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    stars = cut(stars.where("a_root is null or b_root is null or a_root <> b_root").select("a", "b"))
    links = near.union(_linked(stars, sets, percent))
    roots = cut(connected_components(links).withColumnRenamed("node", "rid"))
    placed = cut(members.join(roots, "rid", "left").select("band", F.coalesce("root", "rid").alias("root"), F.struct("rid", "size", "own").alias("at")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    rest = cut(placed.join(mixed, "band"))
    # Two classes meet in the first of the bands that they share (a class has BANDS at most), so that no pair comes twice.
    bands = rest.groupBy("at").agg(F.collect_list("band").alias("bands"))
    bands = bands.join(able.select(F.col("rid").alias("able"), "parts"), F.col("at.rid") == F.col("able")).drop("able")
    rest = cut(rest.join(bands, "at"))
    x, y = (rest.select("band", F.col("at").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in ("root", "bands", "parts"))) for c in "ab")
    # An exact bound on what both hold, the smaller count of each part, parts pairs that share a passage but lack different pieces of it.
    common = "aggregate(zip_with(a_parts, b_parts, (p, q) -> least(p, q)), 0L, (sum, n) -> sum + n)"
    met = x.join(y, "band").where("a_root < b_root").where(fits("a", "b")).where(f"{100 + percent} * {common} >= {percent} * (a.size + b.size)")
    met = met.where("band = array_min(array_intersect(a_bands, b_bands))")
    pairs = met.select(F.least("a.rid", "b.rid").alias("a"), F.greatest("a.rid", "b.rid").alias("b"))
    more = _linked(cut(pairs.join(stars, ["a", "b"], "left_anti")), sets, percent)
    # The links found last join components found before, so only those components' roots are joined once more.
    for c in "ab":
        more = more.withColumnRenamed(c, "rid").join(roots, "rid", "left").withColumn(c, F.coalesce("root", "rid")).drop("rid", "root")
    tops = connected_components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    roots = cut(roots.join(tops, "root", "full").select(F.coalesce("rid", "root").alias("class"), F.coalesce("top", "root").alias("root")))
    return classed.join(roots, "class", "left").select("rid", F.coalesce("root", "class").alias("root"))


def one_near_copy(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies of a row earlier by (id, place in the table), a null id last; all columns stay, whatever their names.

    Rows are judged one by one, whatever their ids: one row of each group stays, also where ids are null or repeat. docs must be a table that reads back in the same order.
    """
    rid = fresh(docs.columns, "row_number")
    placed = docs.withColumn(rid, F.monotonically_increasing_id())
    slim = placed.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = near_copy_groups(slim.select("rid", "text"), shingle, percent).join(slim.select("rid", "id"), "rid")
    groups = cut(groups.select("root", F.struct(F.col("id").isNull().alias("last"), "id", "rid").alias("place")))
    kept = groups.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.rid").alias(rid))
    return placed.join(kept, rid, "left_semi").select(*docs.columns)
