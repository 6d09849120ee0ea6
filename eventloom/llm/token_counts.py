"""Token counts under a sentencepiece BPE model, by whole words where that is proved to be right.

A text is cut where no merge can cross: no piece has the mark ▁ after another character, so every word with the marks before it is merged
alone. Which pieces encode alone as one token is proved once, by merging each of them. A word that is such a piece counts 1; only the
others are merged, once per distinct word while the cache holds it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache

MARK = "▁"


def _vocabulary(path: str) -> dict[str, float]:
    """The ordinary pieces of a model file and their scores; the model must be one that this module's merging follows."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = {model.id_to_piece(k): model.get_score(k) for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    if not any(model.is_byte(k) for k in range(n)) or any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("counting needs a model with byte fallback, and without pieces that go across words")
    return pieces


class PieceCounter:
    """Counts the tokens of texts. whole: the pieces that encode alone as one token, if they are known already."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        scores = _vocabulary(path)
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        letters = {c for p in scores for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in letters)  # characters of no piece, which end a word too
        self.find = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.whole = frozenset(p for p in scores if self.merge(p) == 1) if whole is None else whole
        self.words = WordCache(self.merge, fixed=dict.fromkeys(self.whole, 1))

    def merge(self, word: str) -> int:
        """The tokens of one word: the neighbours whose joint piece has the best score merge first, the leftmost of equals; what is no piece counts its bytes."""
        rank, parts = self.rank, list(word)
        if len(parts) > 48:
            parts = self._merge_long(parts)
        else:
            while len(parts) > 1:
                best, at = None, 0
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return sum([1 if p in rank else len(p.encode()) for p in parts])

    def _merge_long(self, parts: list[str]) -> list[str]:
        """merge() with a heap, for words of any length."""
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, 1) for k in range(n - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
        heap = [(r, k, parts[k] + parts[k + 1]) for r, k, _ in heap]
        heapq.heapify(heap)
        while heap:
            _, k, joint = heapq.heappop(heap)
            m = after[k]
            if m < 0 or not parts[k] or parts[k] + parts[m] != joint:
                continue
            parts[k], parts[m] = joint, ""
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := rank.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left] + parts[right]))
        return [p for p in parts if p]

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find((MARK + text).replace(" ", MARK)))) if text else 0


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> PieceCounter:
    return PieceCounter(path, whole)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The proof: all pieces of the vocabulary that encode alone as one token. As many at most as the vocabulary has."""
    return PieceCounter(path).whole


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of each whole text; over_limit: more than `limit` tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    path must name the model file on every executor.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, proved.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([counter.count(text.as_py()) for text in batch.column(2)], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = picked.mapInArrow(scan, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
