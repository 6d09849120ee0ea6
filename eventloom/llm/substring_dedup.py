"""Repeated word windows, found in a compacted de Bruijn graph.

Edges are windows of k words, nodes the k-1 words that two consecutive windows share. A node through which every document passes the same
way (one edge in, one edge out, never an end) is inside a path; all other nodes branch. Branching nodes are joined back to the places where
they stand, which cuts every document into whole paths: each place of a path holds all of it, so the path's smallest source coordinate is
the smallest one of each of its windows. Hashes only propose: the source's words are brought to every place that repeats them, by their
coordinates, and compared word by word before anything is removed.

Only windows that can repeat enter the graph: a window's anchor is the smallest hash among its short grams, equal windows have equal anchors,
and a window whose anchor stands once in the corpus stands once itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import Texts, chunks, mix, signed, window_hash
from .runtime import cut, drop
from .skew import fresh, join_salted

#: Words in the grams that anchor a window (fewer, if windows are shorter).
GRAM = 6


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i where that fits."""
    n = 1
    while 2 * n <= width:
        x, n = pick(x[:-n], x[n:]), 2 * n
    return pick(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


class _Anchored:
    """Windows of a chunk of texts with their anchors. at: each window's first word; anchor: its anchor's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        gram = min(GRAM, k)
        self.texts = Texts(data, offsets)
        self.words = self.texts.hashes()
        self.at = self.texts.windows(k)
        self.grams = np.full(len(self.words), np.iinfo(np.uint64).max, dtype=np.uint64)
        places = self.texts.windows(gram)
        self.grams[places] = window_hash(self.words, places, gram)
        self.width = k - gram + 1
        least = _slide(self.grams, self.width, np.minimum) if len(self.at) else self.grams[:0]
        self.anchor = least[self.at]

    def places(self) -> np.ndarray:
        """The words where an anchor of some window stands."""
        n, w = len(self.grams), self.width
        reach = np.zeros(n + w - 1, dtype=np.uint64)
        reach[self.at + w - 1] = self.anchor
        return np.flatnonzero((_slide(reach, w, np.maximum) == self.grams) & (self.grams != np.iinfo(np.uint64).max))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), signed(values))


def _anchors(rows: DataFrame, k: int) -> DataFrame:
    """(rid, anchors array<long>): the anchors of each text, one that stands more than once in it twice; texts without a window are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                found = _Anchored(data, offsets, k)
                if not len(found.at):
                    continue
                places = found.places()
                own = np.searchsorted(found.texts.first, places, side="right") - 1
                values = found.grams[places]
                order = np.lexsort((values, own))
                own, values = own[order], values[order]
                again = np.zeros(len(own), dtype=bool)
                again[2:] = (own[2:] == own[:-2]) & (values[2:] == values[:-2])
                own, values = own[~again], values[~again]
                counts = np.bincount(own, minlength=j - i)
                full = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(full)), _lists(values, counts[full])], names=["rid", "anchors"])

    return rows.select("rid", "text").mapInArrow(scan, "rid long, anchors array<long>")


def _runs(rows: DataFrame, flagged: DataFrame, k: int) -> DataFrame:
    """(rid, start long, words array<long>): the maximal runs of windows with repeated anchors, as the hashes of their words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for i, j, data, offsets in chunks(batch.column(1)):
                found = _Anchored(data, offsets, k)
                wanted = np.asarray(marks.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                at = found.at[np.isin(found.anchor, wanted)]
                if not len(at):
                    continue
                own = np.searchsorted(found.texts.first, at, side="right") - 1
                fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(own) != 0)))
                first, last = at[fresh], at[np.concatenate((fresh[1:], [True]))] + k
                counts, row = last - first, own[fresh]
                picked = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                where = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), pa.array(first - found.texts.first[row]), _lists(found.words[picked], counts)], names=["rid", "start", "words"])

    return rows.select("rid", "text").join(flagged.select("rid", "anchors"), "rid").select("rid", "text", "anchors").mapInArrow(scan, "rid long, start long, words array<long>")


def _unpacked(batch: pa.RecordBatch, column: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of runs: word hashes, each run's first word in them, the first words of all nodes, and each node's run."""
    lists = batch.column(column)
    words = np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
    lengths = np.asarray(lists.value_lengths())
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    counts = lengths - k + 2
    run = np.repeat(np.arange(len(lengths)), counts)
    nodes = np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + begins[run]
    return words, begins, nodes, run


def _branching(runs: DataFrame, k: int) -> DataFrame:
    """(node long, n): the nodes that end a path: those with different edges in or out, or where a run begins or ends. n: the places where each stands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begins, nodes, run = _unpacked(batch, 0, k)
            ends = np.concatenate((run[1:] != run[:-1], [True]))
            starts = np.concatenate(([True], ends[:-1]))
            key = window_hash(words, nodes, k - 1)
            before, after = words[np.maximum(nodes - 1, 0)], words[np.minimum(nodes + k - 1, len(words) - 1)]
            way = np.where(starts | ends, np.uint64(0), mix(before) ^ after)
            order = np.lexsort((way, key))
            key, way = key[order], way[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (way[1:] != way[:-1]))))
            yield pa.RecordBatch.from_arrays([signed(key[new]), signed(way[new]), pa.array(np.diff(np.append(new, len(key))))], names=["node", "way", "n"])

    seen = runs.select("words").mapInArrow(scan, "node long, way long, n long").groupBy("node").agg(F.min("way").alias("least"), F.max("way").alias("most"), F.sum("n").alias("n"))
    return seen.where("least <> most or least = 0").select("node", "n")


def _places(runs: DataFrame, k: int) -> DataFrame:
    """(node, rid, pos, sum): where each node stands, pos being twice its first word, plus 1 where a run ends; sum: hashes of the run's windows before it, to be subtracted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, begins, nodes, run = _unpacked(batch, 2, k)
            inside = np.concatenate((run[1:] == run[:-1], [False]))
            step = np.zeros(len(nodes), dtype=np.uint64)
            step[inside] = window_hash(words, nodes[inside], k, 1)
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(step)[:-1]))
            head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            total = total - total[head][run]
            pos = 2 * (np.asarray(batch.column(1))[run] + nodes - begins[run]) + ~inside
            yield pa.RecordBatch.from_arrays([signed(window_hash(words, nodes, k - 1)), batch.column(0).take(pa.array(run)), pa.array(pos), signed(total)], names=["node", "rid", "pos", "sum"])

    return runs.select("rid", "start", "words").mapInArrow(scan, "node long, rid long, pos long, sum long")


def _span_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (rid, from, upto) -> with `words`: the bytes of the words of rows' texts there, joined by one space."""
    wanted = spans.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("from", "upto"))).alias("spans"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer() if text.is_valid else b"", dtype=np.uint8)
                found = Texts(data, np.array([0, len(data)]))
                low, high = (np.asarray(own.values.field(k)) for k in (0, 1))
                for i in range(0, len(low), 1024):  # a text whose passages all repeat is not held several times over
                    some = slice(i, i + 1024)
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(low[some]), pa.int64()), pa.array(low[some]), pa.array(high[some]), pa.array([_joined_words(found, a, b) for a, b in zip(low[some], high[some], strict=True)], pa.large_binary())], names=["rid", "from", "upto", "words"])

    return rows.select("rid", "text").join(wanted, "rid").select("rid", "text", "spans").mapInArrow(scan, "rid long, from long, upto long, words binary")


def agreeing(mine: bytes, theirs: bytes, k: int) -> list[tuple[int, int]]:
    """The runs of k words or more that two passages have in the same places, as (first word, word after the last)."""
    if mine == theirs:
        return [(0, mine.count(b" ") + 1)]
    runs, begin = [], 0
    for at, (x, y) in enumerate([*zip(mine.split(b" "), theirs.split(b" "), strict=False), (b"", b" ")]):
        if x != y:
            runs += [(begin, at)] * (at - begin >= k)
            begin = at + 1
    return runs


def _joined_words(texts: Texts, low: int, high: int) -> bytes:
    return b" ".join(texts.data[texts.starts[low] : texts.ends[high - 1]].tobytes().split())


def repeated_spans(rows: DataFrame, k: int = 20) -> DataFrame:
    """rows (rid long unique, id long, text) -> (rid, spans array<struct<from, upto, words>>): word ranges whose windows also start earlier, and the words that stand there.

    Earlier means a smaller (id, rid), a null id before all others, or the same row and an earlier start. Rows without such a window are left
    out. The ranges are found by hashes; `words` are those of the earlier place, and are still to be compared.
    """
    grams = cut(_anchors(rows, k))
    anchors = grams.select("rid", F.explode("anchors").alias("anchor"))
    repeated = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    flagged = cut(join_salted(anchors, repeated, "anchor", "n", "rid").groupBy("rid").agg(F.collect_set("anchor").alias("anchors")).join(rows.select("rid", "id"), "rid"))
    drop(grams, repeated)
    runs = cut(_runs(rows, flagged, k))
    branching = cut(_branching(runs, k))
    cuts = cut(join_salted(_places(runs, k), branching, "node", "n", "rid"))
    drop(runs, branching)
    in_text = Window.partitionBy("rid").orderBy("pos")
    paths = cuts.select("rid", "node", "pos", F.shiftright(F.lead("pos").over(in_text) - F.col("pos"), 1).alias("n"), F.lead("sum").over(in_text).alias("upto"), "sum").where("pos % 2 = 0")
    # A path's identity: its first node, its length and the hashes of its windows (sums are modulo 2 ** 64, compared through both halves).
    low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    high = lambda c: F.shiftrightunsigned(c, 32)
    paths = paths.withColumn("dl", low("upto") - low("sum")).withColumn("borrow", F.when(F.col("dl") < 0, 1).otherwise(0))
    paths = paths.withColumn("dh", (high("upto") - high("sum") - F.col("borrow")).bitwiseAND(0xFFFFFFFF)).withColumn("check", F.shiftleft("dh", 32).bitwiseOR(F.col("dl").bitwiseAND(0xFFFFFFFF)))
    paths = paths.join(flagged.select("rid", "id"), "rid").withColumn("pos", F.shiftright("pos", 1))
    paths = cut(paths.select(F.struct("node", "n", "check").alias("path"), F.struct("id", "rid", "pos").alias("place")))
    drop(cuts, flagged)
    first = cut(paths.groupBy("path").agg(F.min("place").alias("source"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    again = join_salted(paths, first, "path", "times", "place").where(~F.col("place").eqNullSafe(F.col("source")))
    # Neighbouring paths that repeat neighbouring words of one source are one span.
    again = again.select("place.rid", F.col("place.pos").alias("from"), (F.col("place.pos") + F.col("path.n") + (k - 1)).alias("upto"), F.col("source.rid").alias("source"), (F.col("source.pos") - F.col("place.pos")).alias("off"))
    before = Window.partitionBy("rid").orderBy("from")
    again = again.withColumn("new", F.coalesce((F.lag("source").over(before) != F.col("source")) | (F.lag("off").over(before) != F.col("off")) | (F.lag("upto").over(before) < F.col("from")), F.lit(True)).cast("int"))
    again = again.withColumn("span", F.sum("new").over(before)).groupBy("rid", "span", "source", "off").agg(F.min("from").alias("from"), F.max("upto").alias("upto"))
    again = cut(again.select("rid", "from", "upto", F.struct(F.col("source").alias("rid"), (F.col("from") + F.col("off")).alias("from"), (F.col("upto") + F.col("off")).alias("upto")).alias("origin")))
    drop(paths, first)
    origins = cut(again.groupBy("origin").agg(F.count(F.lit(1)).alias("times")))
    words = _span_words(rows, origins.select("origin.rid", "origin.from", "origin.upto")).select(F.struct("rid", "from", "upto").alias("origin"), "words")
    words = words.join(origins, "origin")
    spans = cut(join_salted(again, cut(words), "origin", "times", "rid").groupBy("rid").agg(F.collect_list(F.struct("from", "upto", "words")).alias("spans")))
    return spans


def dedup_substrings(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less every word that a window of k words covers whose words also start earlier; one row per row of docs.

    Added columns: n_words, n_removed (longs) and kept_sha256, the digest of the kept words joined by one space. Words are runs of non-space
    characters, unchanged. Windows are judged on the input; of repeated rows or ids the first in the order of (id, place in the table) counts
    as earlier, a null id before all. No word goes unless the same words were compared with it at the earlier place. A removed word goes with
    the white space after it; texts that lose nothing stay as they are to the byte. A null text has no words, stays null and hashes as the
    empty string; texts of any length are taken whole, a chunk in memory at a time and a longer text alone; an empty table gives no rows.
    Other columns stay, whatever their names; one that has the name of an added column gives way to it. docs must be a table that reads back
    in the same order.
    """
    added = {"n_words", "n_removed", "kept_sha256"}
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    rid, spans_col = fresh(docs.columns, "row_number"), fresh(docs.columns, "repeated_spans")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    slim = rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(slim, k).select(F.col("rid").alias(rid), F.col("spans").alias(spans_col))
    joined = rows.join(spans, rid, "left")
    text_at, spans_at = joined.columns.index(text_col), joined.columns.index(spans_col)
    kept_columns = {c: joined.columns.index(c) for c in docs.columns}
    schema = ", ".join(f"`{c}` {'string' if c == text_col else joined.schema[c].dataType.simpleString()}" for c in kept_columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            spans = batch.column(spans_at)
            for text, span in zip(batch.column(text_at), spans, strict=True):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                if not span.is_valid:
                    words = data.split()
                    for column, value in zip(out, (text.as_py(), len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                        column.append(value)
                    continue
                found = Texts(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
                gone = np.zeros(len(found.starts) + 1, dtype=np.int32)
                low, high, words = (span.values.field(c) for c in range(3))
                for a, b, w in zip(low.to_pylist(), high.to_pylist(), words, strict=True):
                    for i, j in agreeing(_joined_words(found, a, b), w.as_buffer().to_pybytes(), k):
                        gone[a + i] += 1
                        gone[a + j] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                after = np.append(found.starts[1:], len(data))
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(cover, found.starts[gone], 1)
                np.add.at(cover, after[gone], -1)
                kept = np.frombuffer(data, dtype=np.uint8)[np.cumsum(cover)[:-1] == 0].tobytes()
                for column, value in zip(out, (kept.decode(), len(gone), int(gone.sum()), hashlib.sha256(b" ".join(kept.split())).hexdigest()), strict=True):
                    column.append(value)
            columns = [pa.array(out[0], pa.string()) if c == text_col else batch.column(at) for c, at in kept_columns.items()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=[*kept_columns, "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(scan, f"{schema}, n_words long, n_removed long, kept_sha256 string")
