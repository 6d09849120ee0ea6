"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

Separators are ASCII, so a word's bytes are the same whether it is looked for among characters or among bytes.
A word's 64-bit hash adds up its bytes' random values, each times a random number of its place in the word; a window's hash mixes its words'
hashes pairwise, then the pairs, and so on. Neither has the periodic words on which polynomials modulo 2 ** 64 collide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 21
#: Bytes whose words are hashed together.
HASH_BYTES = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def byte_class(separators: bytes) -> np.ndarray:
    """table[b] tells whether byte b belongs to a word."""
    own = np.ones(256, dtype=bool)
    own[list(separators)] = False
    return own


#: [^\x20\x09-\x0D]+
SPACED = byte_class(b" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def byte_values(family: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD[family])


_PLACES: dict[int, np.ndarray] = {}


def place_values(family: int, n: int) -> np.ndarray:
    """An odd random number for each of the first n places; those of a chunk's length are kept."""
    got = _PLACES.get(family)
    if got is None or len(got) < n:
        got = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * _ODD[1 - family] + _ODD[family]) | np.uint64(1)
        if len(got) <= CHUNK_BYTES:
            _PLACES[family] = got
    return got[:n]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of values[start:end], equal for equal runs wherever they stand. Runs are in order and do not overlap."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(before, lengths)
    inside = values if len(place) == len(values) else values[place + np.repeat(starts, lengths)]
    sums = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(inside * place_values(family, int(lengths.max(initial=0)))[place], out=sums[1:])
    return mix(sums[before + lengths] - sums[before] + lengths.astype(np.uint64) * _ODD[family])


class Texts:
    """Whole texts side by side. data: their bytes; offsets: where each begins, and the end; first: each one's first word, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        inside = words[self.data]
        fresh, last = inside.copy(), inside.copy()
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        fresh[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        fresh[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, family: int = 0) -> np.ndarray:
        own = byte_values(family)
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):  # some words at a time: eight bytes a byte are little then, and stay in the cache
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + HASH_BYTES, side="right")))
            low = self.starts[i]
            out[i:j] = run_hash(own[self.data[low : self.ends[j - 1]]], self.starts[i:j] - low, self.ends[i:j] - low, family)
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def windows(self, k: int) -> np.ndarray:
        """First words of all runs of k words within one text."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, dtype=np.int64)
        own = self.owners()
        return np.flatnonzero(own[: n - k + 1] == own[k - 1 :])


def _joined(x: np.ndarray, y: np.ndarray, family: int) -> np.ndarray:
    z = x * _ODD[family]
    z += y
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hashes of the runs of k words that begin at `at`: of halves that are runs of a power of two, joined again and again."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    done, width, whole, size = None, 0, hashes, 1  # done: of the runs of `width` words; whole: of a power of two
    while width < k:
        if k & size:
            done = whole if done is None else _joined(done[: len(whole) - width], whole[width:], family)
            width += size
        if width < k:
            whole, size = _joined(whole[:-size], whole[size:], family), 2 * size
    return mix(done[at] ^ np.uint64(k))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, data, offsets) for rows i to j, of about CHUNK_BYTES each."""
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_LOWER_TABLE, _SPACE = LOWER.tobytes(), re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: bytes, width: int, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The runs of `width` words of a text with A-Z lower-cased, joined by one space, some at a time; fewer words are one run, no words none.

    About `size` bytes of the text become word objects at once, whatever its length.
    """
    held: list[bytes] = []
    at, first = 0, True
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (space := _SPACE.search(text, end)):
            end = space.start()
        elif end < len(text):
            end = len(text)
        words = held + text[at:end].translate(_LOWER_TABLE).split()
        at = end
        if len(words) >= width:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
            yield [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
            held, first = words[len(words) - width + 1 :], False
        else:
            held = words
    if first and held:
        yield [b" ".join(held)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
