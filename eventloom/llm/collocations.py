"""Phrases of two to four words whose words stand together more than apart, by hashed counts of the next length (PCY, DHP) and Apriori.

Pass k over the texts counts the phrases of k words exactly, but only those that can be frequent, and in the same pass throws the phrases of
k + 1 words into hash buckets. A phrase is counted if its first and its last k - 1 words are frequent (Apriori) and its bucket holds enough
(PCY); a phrase goes into a bucket only if its own k-word parts can be frequent (DHP). Both tests are bitmaps of `buckets` bits whatever the size of the
corpus, so they are broadcast; a bit that is set by another phrase costs work, never a row, as the counts themselves are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, remove, shared_dir

#: Bytes of text that are split and counted at once; words that a slice takes over from the one before.
SLICE, CONTEXT = 4_000_000, 3
#: Buckets that one row of packed counts covers.
CHUNK = 8192
_SPACE, _BREAK = 32, 0xFF  # 0xFF stands in no UTF-8 text
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[9] = _SPACE
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, depending on their order."""
    x = (a ^ (a >> np.uint64(31))) * _MIX + b
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _seeded(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The hash of phrases, given as one array of hashes for each of their words."""
    out = lang
    for w in words:
        out = _mixed(out, w)
    return out


class Words:
    """The words of one slice of texts: code into `names` and hash of each, the number of its piece, its text's language, and how many first ones are context."""

    def __init__(self, names: pa.Array, code: np.ndarray, piece: np.ndarray, lang: np.ndarray, skip: int):
        self.names, self.code, self.piece, self.lang, self.skip = names, code, piece, lang, skip
        self.hash = _hashes(names.to_pylist())[code]

    def ends(self, k: int) -> np.ndarray:
        """Where phrases of k words end that lie in one piece and end beyond the context."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.piece[k - 1 :] == self.piece[: n - k + 1]) + k - 1
        return at[at >= self.skip]

    def buckets_of(self, end: np.ndarray, k: int, langs: np.ndarray, buckets: int) -> np.ndarray:
        """The hash bucket of each phrase of k words ending at `end`; langs: the hash of each language."""
        return (_seeded(langs[self.lang[end]], [self.hash[end - k + 1 + j] for j in range(k)]) % np.uint64(buckets)).astype(np.int64)


def _slices(text: pa.Array, lang: np.ndarray) -> Iterator[Words]:
    """The words of a batch of texts, about SLICE bytes at once; texts of any length are cut between words."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    base, whole = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[base:whole] if whole > base else np.zeros(0, np.uint8)
    bounds, low, context, skip = offsets - base, 0, 0, 0
    while low < len(data):
        high = min(low + SLICE, len(data))
        while high < len(data):  # on to the end of the word
            c = _CLASS[data[high : high + 4096]]
            gap = np.flatnonzero((c == _SPACE) | (c == _BREAK))
            if len(gap):
                high += int(gap[0])
                break
            high = min(high + 4096, len(data))
        c = _CLASS[data[context:high]]
        solid = (c != _SPACE) & (c != _BREAK)
        new_text = np.zeros(len(c) + 1, dtype=np.int32)  # how many texts begin at each byte
        inside = bounds[(bounds >= context) & (bounds <= high)] - context
        np.add.at(new_text, inside, 1)
        starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1]) if len(solid) else []) | solid & (new_text[:-1] > 0))
        if len(starts):
            piece = np.cumsum((c == _BREAK) + new_text[:-1])[starts]
            filled = np.concatenate(([0], np.cumsum(solid)))
            edges = np.append(filled[starts], filled[-1])
            raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(c[solid])])
            coded = raw.dictionary_encode()
            row = np.searchsorted(bounds, starts + context, side="right") - 1
            yield Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, lang[row], skip)
            skip = min(CONTEXT, len(starts))
            context = context + int(starts[-skip])
        else:
            context, skip = high, 0
        low = high


def _bits(bitmap: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(bitmap, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _packed(bucket: np.ndarray, least: int) -> pa.RecordBatch:
    """Counts of buckets as rows of CHUNK buckets: their places in it (2 bytes each) and counts, which may stop at `least`, as that is all that is asked."""
    where, n = np.unique(bucket, return_counts=True)
    chunk = where // CHUNK
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    edges = np.append(first, len(where))
    pack = lambda a: pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer((edges * a.itemsize).astype(np.int64)), pa.py_buffer(a)])
    return pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int32()), pack((where % CHUNK).astype(np.uint16)).cast(pa.binary()), pack(np.minimum(n, least).astype(_count_type(least))).cast(pa.binary())], names=["chunk", "places", "counts"])


def _count_type(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _exact(words: Words, end: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The phrases that end at `end`, as (text, language, count), each once; codes are joined in pairs, so that no two phrases are mixed up."""
    key, size = words.lang[end], int(words.lang.max(initial=0)) + 1
    for j in range(k):
        if size > 2**62 // max(1, len(words.names)):  # keys stay in 64 bits: number what there is
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max(initial=0)) + 1
        key, size = key * len(words.names) + words.code[end - j], size * len(words.names)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    at = end[first]
    parts = [words.names.take(pa.array(words.code[at - k + 1 + j])) for j in range(k)]
    text = pc.binary_join_element_wise(*[p.cast(pa.large_string()) for p in parts], pa.scalar(" ", pa.large_string())) if k > 1 else parts[0].cast(pa.large_string())
    return text.cast(pa.string()), words.lang[at], n


def _possible(words: Words, end: np.ndarray, k: int, langs: np.ndarray, buckets: int, parts: bytes, hot: bytes) -> np.ndarray:
    """Those of the phrases of k words ending at `end` that can be frequent: their bucket is, and so are their first and last k - 1 words."""
    for off, n, bitmap in ((0, k, hot), (0, k - 1, parts), (1, k - 1, parts)):
        end = end[_bits(bitmap, words.buckets_of(end - off, n, langs, buckets))]
    return end


def _scan(texts: DataFrame, k: int, least: int, buckets: int, longest: int, parts: bytes | None, hot: bytes | None) -> DataFrame:
    """Pass k: rows with a phrase count phrases of k words, rows with a chunk the buckets of phrases of k + 1 words; both slice by slice, to be summed.

    parts: bits of the frequent phrases of k - 1 words; hot: bits of the buckets of k words that hold enough; both None in the first pass.
    """
    sent = texts.sparkSession.sparkContext.broadcast((parts, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hot = sent.value
        for batch in batches:
            kinds = pc.dictionary_encode(batch.column(0))
            langs = _hashes([x.encode() for x in kinds.dictionary.to_pylist()])
            for words in _slices(batch.column(1), kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)):
                end = words.ends(k)
                if parts is not None:
                    end = _possible(words, end, k, langs, buckets, parts, hot)
                if len(end):
                    text, lang, n = _exact(words, end, k)
                    none = pa.nulls(len(n), pa.binary())
                    yield pa.RecordBatch.from_arrays([kinds.dictionary.take(pa.array(lang)), text, pa.array(n), pa.nulls(len(n), pa.int32()), none, none], names=_NAMES)
                longer = words.ends(k + 1) if k < longest else end[:0]
                if parts is not None and len(longer):
                    ok = np.zeros(len(words.code), dtype=bool)
                    ok[end], ok[: words.skip] = True, True  # a part that ends in the context is not looked at here: let it through
                    longer = longer[ok[longer] & ok[longer - 1]]
                if len(longer):
                    packed = _packed(words.buckets_of(longer, k + 1, langs, buckets), least)
                    none = pa.nulls(len(packed), pa.string())
                    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(packed), pa.int64()), *packed.columns], names=_NAMES)

    return texts.mapInArrow(run, "lang string, phrase string, c long, chunk int, places binary, counts binary")


_NAMES = ["lang", "phrase", "c", "chunk", "places", "counts"]


def _bitmap(packed: DataFrame, least: int, buckets: int) -> bytes:
    """Bits of the buckets whose counts add up to `least`; packed: chunk, places, counts. A task adds up whole chunks as they stream in; the driver gets the bits, `buckets` of them whatever came in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sums = np.zeros((0, CHUNK), dtype=np.int64)
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            row = np.array([known.setdefault(c, len(known)) for c in chunk.tolist()], dtype=np.int64)
            if len(known) > len(sums):
                sums = np.concatenate((sums, np.zeros((len(known) - len(sums), CHUNK), dtype=np.int64)))
            places = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16)
            counts = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=_count_type(least))
            each = np.asarray(pc.binary_length(batch.column(1))) // 2
            sums += np.bincount(np.repeat(row, each) * CHUNK + places, counts, sums.size).astype(np.int64).reshape(sums.shape)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([np.packbits(r >= least, bitorder="little").tobytes() for r in sums], pa.binary())], names=["chunk", "bits"])

    spark = packed.sparkSession
    parts = min(buckets // CHUNK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = np.zeros((buckets // CHUNK, CHUNK // 8), dtype=np.uint8)
    for chunk, found in packed.repartition(parts, "chunk").mapInArrow(add, "chunk int, bits binary").collect():
        bits[chunk] = np.frombuffer(found, dtype=np.uint8)
    return bits.tobytes()


def _bits_of(frequent: DataFrame, buckets: int) -> bytes:
    """Bits of the buckets of given phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = np.zeros(len(batch), dtype=np.uint64)
                split = [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
                lang = _hashes([x.encode() for x in batch.column(0).to_pylist()])
                for n in {len(p) for p in split}:
                    at = np.array([i for i, p in enumerate(split) if len(p) == n])
                    found[at] = _seeded(lang[at], [_hashes([split[i][j] for i in at]) for j in range(n)])
                yield _packed((found % np.uint64(buckets)).astype(np.int64), 1)

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, "chunk int, places binary, counts binary"), 1, buckets)


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, buckets: int = 1 << 24, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a): every phrase of 1 to `longest` words that occurs `least` times or more in its language; (lang, n): all word occurrences).

    Words, pieces, nulls and overlaps are as `collocations` states them. buckets: bits of each bitmap, a multiple of CHUNK; fewer cost work, not rows.
    """
    if buckets % CHUNK or least < 1 or longest > CONTEXT + 1:
        raise ValueError(f"buckets must be a multiple of {CHUNK}, least at least 1, phrases at most {CONTEXT + 1} words")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = hot = totals = frequent = None
    for k in range(1, longest + 1):
        folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
        _scan(texts, k, least, buckets, longest, parts, hot).write.parquet(folder)
        seen = spark.read.schema("lang string, phrase string, c long, chunk int, places binary, counts binary").parquet(folder)
        counted = seen.where("phrase is not null")
        found = cut(counted.groupBy("lang", "phrase").agg(F.sum("c").alias("a")).where(F.col("a") >= least).select("lang", "phrase", F.lit(k).alias("words"), "a"))
        if k == 1:
            totals = cut(counted.groupBy("lang").agg(F.sum("c").alias("n")))
        if k < longest:
            parts, hot = _bits_of(found, buckets), _bitmap(seen.where("chunk is not null").select("chunk", "places", "counts"), least, buckets)
        remove(spark, folder)
        frequent = found if frequent is None else frequent.union(found)
    return frequent, totals


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """frequent (lang, phrase, words, a) -> its phrases of two words and more with l, r, score, and `covered`, the largest count of a longer phrase around it (0: none).

    Cut after its first k words a phrase has l = count of the first part, r = count of the rest, score = floor(2000000 a / (l + r)), exactly;
    the cut of the lowest score counts, the smallest k of equals.
    """
    words = F.split("phrase", " ", -1)
    long = frequent.where("words > 1").select("lang", "phrase", "words", "a", words.alias("w"))
    part = lambda low, n: F.array_join(F.slice("w", low, n), " ")
    cuts = long.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = frequent.select("lang", "phrase", "a")
    for side, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr("cast(2000000 * cast(a as decimal(38, 0)) div (cast(l as decimal(38, 0)) + cast(r as decimal(38, 0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("words").alias("words"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter phrase of two words and more inside one, with the count of the longest-lived phrase around it.
    spans = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), p -> array_join(slice(w, p, n), ' '))))")
    around = long.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    scored = best.join(around, ["lang", "phrase"], "left")
    return scored.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"))


#: Parts in which a language's phrases are ranked before the best of each part are ranked together.
RANKED_IN = 64


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, buckets: int = 1 << 24, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to 4 words by (score, a) descending, phrase ascending by bytes.

    Texts are lower-cased in A-Z, split at [.,;:!?] and line ends into pieces, those at spaces and tabs into words; a phrase stands within a piece, and
    overlapping occurrences count. Phrases that occur `least` times or more in their language are candidates; one goes if a longer one around it has at
    least `cover` per cent of its count. A null text is empty, a null language `und`; repeated rows count each time; texts of any length are
    read whole, slice by slice; ids and other columns are not read; an empty table gives no rows.
    """
    frequent, totals = phrase_counts(docs, least, 4, buckets, text_col, lang_col)
    scored = scored_phrases(frequent)
    exact = lambda c: F.col(c).cast("decimal(38, 0)")
    left = scored.where(~((F.col("covered") > 0) & (100 * exact("covered") >= cover * exact("a"))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN))
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
