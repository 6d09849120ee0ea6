"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its encoding. The tokens that end at each place come from an automaton over the
vocabulary; one of them is the prefix's last token when it begins at the word's start, or when the last token of what stands before it stays
apart from it under the merge rules. Following the last tokens back from the word's end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache

#: The public byte-level pre-tokenizer: contractions, letters, digits and other signs with one space before, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe:
    """The vocabulary and merges of a tokenizers file with a byte-level pre-tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = _byte_letters()
        plain = lambda token: "".join(chr(letter[c]) for c in token)  # noqa: E731  one character a byte
        vocab = {plain(token): k for token, k in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {k: token.encode("latin-1") for token, k in vocab.items()} | {k: t.encode() for t, k in self.added.items()}
        #: rank: a token's place in the order of merges, none for single bytes; parts: the two tokens of its merge.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (plain(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = vocab[a + b]
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (vocab[a], vocab[b])
            self.merged.setdefault((vocab[a], vocab[b]), rank)
        self.automaton = ahocorasick.Automaton()
        for token, k in vocab.items():
            if len(token) == 1 or k in self.rank:
                self.automaton.add_word(token, (len(token), k))
        self.automaton.make_automaton()
        self.apart = lru_cache(maxsize=1 << 18)(self._apart)
        self.words = WordCache(self._entry)
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _apart(self, left: int, right: int) -> bool:
        """Whether left then right is how their joined bytes are encoded.

        Taken apart merge by merge, the latest first: at each step the two tokens that face each other across the border must not
        have had a merge that came before the one just undone.
        """
        until = float("inf")
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < until:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # The left token's last merge happened at rank a: a merge across the border at the same rank would have come after it.
                until, left = a, self.parts[left][1]
            else:
                # Of equal ranks the left place goes first, so a border merge of rank b stands before the right token's.
                until, right = b + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        data = word.encode("utf-8").decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * (len(data) + 1)
        for end, (size, token) in self.automaton.iter(data):
            if last[end + 1] is None:
                begin = end + 1 - size
                if begin == 0 or self.apart(last[begin][1], token):
                    last[end + 1] = (size, token)
        ids, at = [], len(data)
        while at:
            size, token = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def _entry(self, word: str) -> tuple[str, int, bytes]:
        ids = self.encode_word(word)
        return ",".join(map(str, ids)), len(ids), b"".join(self.text[k] for k in ids)

    def entries(self, text: str) -> list[tuple[str, int, bytes]]:
        """(decimal ids joined by commas, their number, their bytes) of each pre-token; an added token's string is that token."""
        if self.specials is None or not self.specials.search(text):
            return list(map(self.words.__getitem__, self.find(text)))
        out = []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                token = self.added[part]
                out.append((str(token), 1, self.text[token]))
            else:
                out.extend(map(self.words.__getitem__, self.find(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(k) for e in self.entries(text) for k in e[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.text[k] for k in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The tokenizer of a file that every executor has under this path; kept for the life of the worker."""
    return Bpe(path)


def _per_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): each whole text's ids. A null text counts as empty and has no ids; repeated rows stay; an empty table gives no rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return _per_text(docs, id_col, text_col).mapInArrow(scan, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the text of each list of ids; bytes that are no UTF-8 become U+FFFD. A null list gives the empty text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    picked = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(scan, "id long, text string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded again, in one pass that keeps only the digests.

    ids_sha256 is the lowercase hex digest of the decimal ids joined by commas, decoded_sha256 that of the decoded text. A null text counts as
    empty; an empty one has 0 tokens and the digests of the empty string. Repeated rows and null ids stay; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                entries = bpe.entries(text.as_py())
                n.append(sum([e[1] for e in entries]))
                ids.append(hashlib.sha256(",".join([e[0] for e in entries]).encode()).hexdigest())
                whole = b"".join([e[2] for e in entries])
                back.append(hashlib.sha256(whole.decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _per_text(docs, id_col, text_col).mapInArrow(scan, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
